"""envlake.sources"""
