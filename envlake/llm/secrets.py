"""Secret scans: named patterns, and sliding-window Shannon entropy with an allow-list.

DataFrame and SQL functions only. A match's place follows from splitting the text by the same
pattern: pieces and matches alternate, so their lengths add up to every start and end (code
points, end exclusive).

Base kinds: ``assign`` (a key word, a separator and a value of six or more characters),
``access`` (AKIA and more, 20 or more characters) and ``hex`` (24 or more lower-case digits).
Entropy kinds: runs of 20 or more characters of ``[A-Za-z0-9+/=_-]`` are cut at the base spans, and each
piece of 20 or more characters with a digit is a candidate of its own, unless the allow-list names
it. A window of 20 characters slides over it, one character in and one out: the counts and the sum of
``c * log2 c`` are updated for these two alone. A piece that isn't hex digits throughout is one
``entropy_base64`` span if some window reaches that class's entropy; otherwise each of its maximal stretches
of 20 or more hex digits, with a digit, is judged alone and is an ``entropy_hex`` span if some window reaches the
entropy of hex digits.

Defined results: a null or empty text has no span; repeated rows are scanned each.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlake.llm.common import id_text

WINDOW = 20
# The kinds in their order, and the patterns of the base kinds.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
ASSIGN = ("([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
          "|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/=_-]{20,}"

#: Bits that a window must reach. Twenty random hex digits have about 3.4, base64 characters 4.1.
LEAST = {"entropy_hex": 2.95, "entropy_base64": 3.7}
_ALPHABET = {"entropy_hex": "0123456789abcdefABCDEF",
             "entropy_base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"}

#: Candidates that are no secrets, each pattern for the whole of it: identifiers of a public form, short sample
#: keys that say so at their end, words and numbers joined by signs.
ALLOW = ("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "^[0-9+/=_-]+$",
         "^[A-Za-z0-9_-]{0,16}([eE][xX][aA][mM][pP][lL][eE]|[sS][aA][mM][pP][lL][eE]|[pP][lL][aA][cC][eE][hH][oO][lL][dD][eE][rR]|[xX]{4,})$",
         "^([A-Z]?[a-z]*|[A-Z]*|[0-9]*)([+/=_-]+([A-Z]?[a-z]*|[A-Z]*|[0-9]*))+$")
#: A maximal stretch of hex digits that is judged alone.
STRETCH = "(?<![0-9a-fA-F])[0-9a-fA-F]{20,}"

_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pieces(hits: str, pattern: str, text: str = "text") -> str:
    """SQL for what lies before each match in ``hits``."""
    return f"CASE WHEN size({hits}) > 0 THEN slice(split({text}, {_quoted(pattern)}, -1), 1, size({hits})) ELSE {hits} END"


def _spans(hits: str, pieces: str, kind: int, at: str = "0L") -> str:
    """SQL for the spans of the matches in ``hits``, which ``pieces`` come before, in a text that begins at ``at``."""
    return f"""aggregate(zip_with({hits}, {pieces}, (m, p) -> named_struct('before', length(p), 'own', length(m))),
        named_struct('at', CAST({at} AS BIGINT), 'out', CAST(array() AS {_SPANS})),
        (a, x) -> named_struct('at', a.at + x.before + x.own, 'out', concat(a.out,
            array(named_struct('start', a.at + x.before, 'kind', {kind}, 'end', a.at + x.before + x.own)))),
        a -> a.out)"""


def _entropy(text: str, kind: str) -> str:
    """SQL for the highest entropy of a window sliding over ``text``, by counts kept up to date."""
    letters, w = _ALPHABET[kind], WINDOW
    g = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(w + 2)) + ")"
    out = f"(CASE WHEN size(a.win) = {w} THEN a.win[0] END)"
    less = f"""named_struct(
        'c', CASE WHEN size(a.win) = {w} THEN transform(a.c, (v, j) -> v - CASE WHEN j = {out} THEN 1 ELSE 0 END) ELSE a.c END,
        's', CASE WHEN size(a.win) = {w} THEN a.s - {g}[a.c[{out}]] + {g}[a.c[{out}] - 1] ELSE a.s END)"""
    total = f"(q.s - {g}[q.c[x]] + {g}[q.c[x] + 1])"
    return f"""aggregate(transform(split({text}, ''), ch -> instr('{letters}', ch) - 1),
        named_struct('c', array_repeat(0, {len(letters)}), 's', 0D, 'best', 0D, 'win', CAST(array() AS array<int>)),
        (a, x) -> transform(array({less}), q -> named_struct(
            'c', transform(q.c, (v, j) -> v + CASE WHEN j = x THEN 1 ELSE 0 END), 's', {total},
            'best', greatest(a.best, CASE WHEN size(a.win) >= {w - 1} THEN {math.log2(w)!r}D - {total} / {w} ELSE 0D END),
            'win', concat(CASE WHEN size(a.win) = {w} THEN slice(a.win, 2, {w - 1}) ELSE a.win END, array(x))))[0],
        a -> a.best)"""


def find_secrets(docs: DataFrame, *more: str, allow: tuple[str, ...] = ALLOW, least: dict[str, float] = LEAST) -> DataFrame:
    """``(doc_id, text, *more, base, extra)``: two arrays of ``(start, kind, end)``, in order."""
    # a run of hex digits or of candidate characters fails as a whole, so only its first one is tried
    patterns = {"_assign": ASSIGN, "_access": ACCESS, "_hex": "(?<![0-9a-f])" + HEX, "_run": "(?<![A-Za-z0-9+/=_-])" + CANDIDATE}
    found = id_text(docs, *more).select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(c)
                                               for c, p in patterns.items()])
    split = found.select("*", *[F.expr(_pieces(c, p)).alias(f"{c}_before") for c, p in patterns.items()],
                         F.expr(f"CASE WHEN size(_assign) > 0 THEN regexp_extract_all(text, {_quoted(ASSIGN)}, 2) "
                                "ELSE _assign END").alias("_value"))
    placed = split.select(
        "doc_id", "text", *more,
        F.expr(f"transform(filter(zip_with({_spans('_assign', '_assign_before', 0)}, _value, "
               "(s, v) -> named_struct('s', s, 'v', v)), z -> length(z.v) >= 6), z -> z.s)").alias("_s0"),
        F.expr(_spans("_access", "_access_before", 1)).alias("_s1"),
        F.expr(_spans("_hex", "_hex_before", 2)).alias("_s2"),
        F.expr(f"filter(zip_with({_spans('_run', '_run_before', 3)}, _run, "
               "(s, r) -> named_struct('s', s, 'r', r)), z -> z.r RLIKE '[0-9]')").alias("_cand"))
    based = placed.select("doc_id", "text", *more, F.expr("array_sort(concat(_s0, _s1, _s2))").alias("base"), "_cand")
    # what the base spans leave of each run
    gap = "named_struct('s', a.at, 'e', {end})"
    left = f"""flatten(transform(_cand, z -> transform(aggregate(
        filter(base, b -> b.start < z.s.end AND b.end > z.s.start),
        named_struct('at', z.s.start, 'out', CAST(array() AS array<struct<s:bigint,e:bigint>>)),
        (a, b) -> named_struct('at', greatest(a.at, b.end), 'out', CASE WHEN b.start > a.at THEN concat(a.out, array({gap.format(end="b.start")})) ELSE a.out END),
        a -> CASE WHEN a.at < z.s.end THEN concat(a.out, array({gap.format(end="z.s.end")})) ELSE a.out END),
        g -> named_struct('s', g.s, 'e', g.e, 'r', substring(z.r, CAST(g.s - z.s.start + 1 AS INT), CAST(g.e - g.s AS INT))))))"""
    allowed = " OR ".join(f"z.r RLIKE {_quoted(a)}" for a in allow) or "false"
    pieces = based.withColumn("_piece", F.expr(f"""CASE WHEN size(_cand) = 0 THEN NULL ELSE
        filter({left}, z -> z.e - z.s >= {WINDOW} AND z.r RLIKE '[0-9]' AND NOT ({allowed})) END""")).drop("_cand")
    # a piece is one span, or its stretches of hex digits are judged
    whole = f"(NOT z.r RLIKE '^[0-9a-fA-F]+$' AND {_entropy('z.r', 'entropy_base64')} >= {least['entropy_base64']!r}D)"
    told = pieces.withColumn("_told", F.expr(f"transform(_piece, z -> named_struct('s', z.s, 'e', z.e, 'r', z.r, 'whole', {whole}))")).drop("_piece")
    hits = f"regexp_extract_all(z.r, {_quoted(STRETCH)}, 0)"
    stretches = told.withColumn("_hexes", F.expr(f"""flatten(transform(filter(_told, z -> NOT z.whole), z -> transform(
        {_spans(hits, _pieces(hits, STRETCH, "z.r"), 3, "z.s")}, x -> named_struct('x', x, 'r', substring(z.r, CAST(x.start - z.s + 1 AS INT), CAST(x.end - x.start AS INT))))))"""))
    extra = f"""CASE WHEN coalesce(size(_told), 0) <= 0 THEN CAST(array() AS {_SPANS}) ELSE array_sort(concat(
        transform(filter(_told, z -> z.whole), z -> named_struct('start', z.s, 'kind', 4, 'end', z.e)),
        transform(filter(_hexes, h -> h.r RLIKE '[0-9]' AND {_entropy('h.r', 'entropy_hex')} >= {least['entropy_hex']!r}D), h -> h.x))) END"""
    return stretches.select("doc_id", "text", *more, "base", F.expr(extra).alias("extra"))


def _written(spans: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(array({kinds})[x.kind], ':', x.start, ':', x.end)), ',')"


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    def n(kind: int) -> F.Column:
        return F.expr(f"CAST(size(filter(base, x -> x.kind = {kind})) AS BIGINT)")
    return find_secrets(docs).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(F.expr(_written("base")), 256).alias("base_sha256"),
        F.expr(_written("array_sort(concat(base, extra))")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with each secret (overlapping spans as one) replaced by ``mark``;
    ``n_chars`` follows where a text changes. Rows without secrets stay as they are."""
    names = docs.columns
    kept = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), "doc_id", "text")
    found = find_secrets(kept, "_row")
    joined = found.select("_row", "text", F.array_sort(F.concat("base", "extra")).alias("_all"))
    cut = f"""aggregate(_all, named_struct('at', 0L, 'out', ''),
        (a, x) -> CASE WHEN x.start >= a.at AND NOT (x.start = a.at AND a.at > 0)
            THEN named_struct('at', x.end, 'out', concat(a.out, substring(text, CAST(a.at + 1 AS INT), CAST(x.start - a.at AS INT)), '{mark}'))
            ELSE named_struct('at', greatest(a.at, x.end), 'out', a.out) END,
        a -> concat(a.out, substring(text, CAST(a.at + 1 AS INT))))"""
    changed = joined.select("_row", F.when(F.size("_all") > 0, F.expr(cut)).alias("_new"))
    kinds = dict(docs.dtypes)

    def column(c: str) -> F.Column:
        old = F.col("_row").getField(c)
        if c == "text":
            return F.coalesce("_new", old).alias(c)
        if c == "n_chars":
            return F.when(F.col("_new").isNotNull(), F.length("_new")).otherwise(old).cast(kinds[c]).alias(c)
        return old.alias(c)
    return changed.select(*[column(c) for c in names])


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds(k, name, pat) AS (VALUES (0, 'assign', '{ASSIGN.replace("'", "''")}'), (1, 'access', '{ACCESS}'),
                               (2, 'hex', '{HEX}'), (3, 'run', '{CANDIDATE}')),
per_kind AS (
    SELECT doc_id, 0 AS k, regexp_extract_all(t, '{ASSIGN.replace("'", "''")}', 0) AS m, regexp_extract_all(t, '{ASSIGN.replace("'", "''")}', 2) AS v,
           string_split_regex(t, '{ASSIGN.replace("'", "''")}') AS p FROM d
    UNION ALL SELECT doc_id, 1, regexp_extract_all(t, '{ACCESS}', 0), NULL, string_split_regex(t, '{ACCESS}') FROM d
    UNION ALL SELECT doc_id, 2, regexp_extract_all(t, '{HEX}', 0), NULL, string_split_regex(t, '{HEX}') FROM d
    UNION ALL SELECT doc_id, 3, regexp_extract_all(t, '{CANDIDATE}', 0), NULL, string_split_regex(t, '{CANDIDATE}') FROM d),
flat AS (
    SELECT doc_id, k, unnest(range(1, len(m) + 1)) AS i, m, v, p FROM per_kind WHERE len(m) > 0),
one AS (SELECT doc_id, k, i, m[i] AS m, v[i] AS v, p[i] AS p FROM flat),
at_end AS (
    SELECT doc_id, k, m, v, sum(length(p) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM one),
placed AS (SELECT doc_id, k, m, v, (e - length(m))::BIGINT AS s, e::BIGINT AS e FROM at_end),
base AS (SELECT * FROM placed WHERE k IN (1, 2) OR (k = 0 AND length(v) >= 6)),
runs AS (SELECT *, row_number() OVER (ORDER BY doc_id, s) AS c FROM placed WHERE k = 3),
free AS (
    SELECT doc_id, c, s, m, p, p - row_number() OVER (PARTITION BY c ORDER BY p) AS g FROM (SELECT *, unnest(range(s, e)) AS p FROM runs) x
    WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s <= x.p AND b.e > x.p)),
piece AS (
    SELECT doc_id, min(p) AS s, max(p) + 1 AS e, substr(any_value(m), (min(p) - any_value(s) + 1)::INT, count(*)::INT) AS m FROM free GROUP BY doc_id, c, g),
cand AS (
    SELECT *, row_number() OVER (ORDER BY doc_id, s) AS c, regexp_matches(m, '^[0-9a-fA-F]+$') AS hexa FROM piece
    WHERE length(m) >= {WINDOW} AND regexp_matches(m, '[0-9]') AND NOT ({" OR ".join(f"regexp_matches(m, '{a}')" for a in ALLOW)})),
windows AS (SELECT c, m, unnest(range(0, length(m) - {WINDOW - 1})) AS w FROM cand),
letters AS (SELECT c, w, unnest(string_split(substr(m, w + 1, {WINDOW}), '')) AS ch FROM windows),
counted AS (SELECT c, w, ch, count(*) AS n FROM letters GROUP BY ALL),
bits AS (SELECT c, w, -sum(n / {WINDOW}.0 * log2(n / {WINDOW}.0)) AS h FROM counted GROUP BY ALL),
whole AS (SELECT c, max(h) AS h FROM bits GROUP BY c HAVING max(h) >= {LEAST["entropy_base64"]}),
hexes AS (
    SELECT c, doc_id, s, w - row_number() OVER (PARTITION BY c ORDER BY w) AS g, w, ch
    FROM (SELECT c, doc_id, s, m, unnest(range(0, length(m))) AS w, unnest(string_split(m, '')) AS ch FROM cand
          WHERE hexa OR c NOT IN (SELECT c FROM whole)) WHERE regexp_matches(ch, '[0-9a-fA-F]')),
stretch AS (
    SELECT c, doc_id, s + min(w) AS s, s + max(w) + 1 AS e, min(w) AS w0, max(w) AS w1 FROM hexes GROUP BY c, doc_id, s, g
    HAVING count(*) >= {WINDOW} AND bool_or(regexp_matches(ch, '[0-9]'))),
best AS (SELECT t.c, t.s, max(h) AS h FROM stretch t JOIN bits b ON b.c = t.c AND b.w >= w0 AND b.w + {WINDOW - 1} <= w1 GROUP BY t.c, t.s),
extra AS (
    SELECT doc_id, 4 AS k, s, e FROM cand WHERE NOT hexa AND c IN (SELECT c FROM whole)
    UNION ALL SELECT doc_id, 3, t.s, t.e FROM stretch t JOIN best b ON b.c = t.c AND b.s = t.s WHERE h >= {LEAST["entropy_hex"]}),
every AS (
    SELECT doc_id, k, s, e, list_extract({list(KINDS)!r}, k + 1) || ':' || s || ':' || e AS w
    FROM (SELECT doc_id, k, s, e FROM base UNION ALL SELECT doc_id, k, s, e FROM extra)),
told AS (
    SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
           string_agg(w, ',' ORDER BY s, k, e) FILTER (k < 3) AS base, string_agg(w, ',' ORDER BY s, k, e) AS spans
    FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (doc_id)
"""
