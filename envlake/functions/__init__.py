"""Column expressions (built-in Spark functions only; no Python UDFs)."""

from envlake.functions.boundary import next_boundary
from envlake.functions.compensation import (compensate_humidity, compensate_temperature,
                                            cpu_temperature, dewpoint)
from envlake.functions.dtypes import canonical_dtypes
from envlake.functions.gas import gas_resistance
from envlake.functions.paths import partition_path_class
from envlake.functions.station_id import canonical_station_id, valid_station_id

__all__ = [
    "next_boundary", "compensate_humidity", "compensate_temperature", "cpu_temperature",
    "dewpoint", "canonical_dtypes", "gas_resistance", "partition_path_class",
    "canonical_station_id", "valid_station_id",
]
