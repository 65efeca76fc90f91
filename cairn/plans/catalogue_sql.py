"""DuckDB SQL of the catalogue's queries, written from the rules and apart from the Spark plans."""

from __future__ import annotations

from ..functions import fixed
from .frames import A_SQL, K_SQL, L_SQL, S_SQL, V_SQL

FOOTERS = "/root/testdata/sf0.01/*.parquet"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _any(text: str, patterns) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in patterns) + ")"


BASE = "regexp_extract({}, '[^/]*$')"
NAME_BASE = BASE.format("name")
ITEMSIZE = "CASE dtype WHEN 'float32' THEN 4 WHEN 'int16' THEN 2 WHEN 'uint8' THEN 1 ELSE 8 END"
MIB = "1048576.0"

PARQUET_INVENTORY = f"""
SELECT regexp_extract(file_name, '[^/]*$') AS asset_id, split_part(path_in_schema, ',', 1) AS name, column_id AS ordinal, sum(total_compressed_size)::BIGINT AS size_bytes, sum(row_group_num_rows)::BIGINT AS n_rows
FROM parquet_metadata('{FOOTERS}') GROUP BY ALL"""
PARQUET_CODEC_AUDIT = f"""
SELECT asset_id, codec, CASE WHEN codec IN {_in(fixed.UNCOMPRESSED)} THEN 'fail' WHEN regexp_matches(codec, 'gzip|zlib|deflate') THEN 'warn' WHEN regexp_matches(codec, 'zstd|blosc') THEN 'pass' ELSE 'warn' END AS status, count(*) AS n_columns
FROM (SELECT regexp_extract(file_name, '[^/]*$') AS asset_id, column_id, lower(min(compression)) AS codec FROM parquet_metadata('{FOOTERS}') GROUP BY ALL) GROUP BY ALL"""

DETECT_INPUT = f"""
SELECT page_id, CASE WHEN regexp_matches(s, '^G[0-9]+-[A-Z0-9_.]+$') THEN 'granule-id' WHEN lower(regexp_extract(s, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN {_in(fixed.URL_SCHEMES)} THEN 'url' ELSE 'local' END AS kind
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('G', page_id, '-PROV.A_1') WHEN 2 THEN concat('/data/f', page_id, '.nc') ELSE concat('s3://b/', page_id) END AS s FROM pages)"""

_EXT = ", ".join(f"('{e}', '{f}')" for e, f in fixed.EXTENSIONS.items())
EXT_HINT = f"""
WITH {V_SQL}, ext(e, hint) AS (VALUES {_EXT}),
p AS (SELECT ordinal, lower(concat(name, CASE ordinal % 6 WHEN 0 THEN '.copc.laz' WHEN 1 THEN '.NC4' WHEN 2 THEN '.zarr' WHEN 3 THEN '' WHEN 4 THEN '.tif' ELSE '.laz' END)) AS path FROM V)
SELECT ordinal, (SELECT arg_max(hint, length(e)) FROM ext WHERE ends_with(path, e)) AS hint FROM p"""
FORMAT_CLASSES = f"""
WITH {V_SQL} SELECT format, CASE WHEN format IN {_in(fixed.CLOUD_NATIVE)} THEN 'cloud-native' WHEN format IN {_in(fixed.CLOUD_OPTIMIZABLE)} THEN 'cloud-optimizable' WHEN format IN {_in(fixed.CLOUD_HOSTILE)} THEN 'cloud-hostile' ELSE 'unknown' END AS class, count(*) AS n FROM V GROUP BY ALL"""

# The expected format of each head by its construction; behind padding only the later HDF5 place and zero bytes count.
SNIFF_MAGIC = """
WITH m(i, f) AS (VALUES (0, 'hdf5'), (1, 'netcdf3'), (2, 'hdf4'), (3, 'unknown'), (4, 'kerchunk'), (5, 'parquet'), (6, 'cog'), (7, 'grib2'), (8, 'flatgeobuf'), (9, 'las'), (10, 'pmtiles'), (11, 'zip'), (12, 'gzip'), (13, 'shapefile'), (14, 'unknown'))
SELECT doc_id, CASE WHEN doc_id % 31 = 30 AND doc_id % 15 <> 0 THEN 'unknown' ELSE f END AS format FROM documents JOIN m ON doc_id % 15 = i"""


def _token(name: str, token: str) -> str:
    return f"({name} = {token} OR ltrim({name}, '/') = ltrim({token}, '/') OR regexp_extract({name}, '[^/]*$') = {token} OR contains(lower({name}), lower({token})))"


MATCH = f"""
WITH {V_SQL}, t(token) AS (VALUES ('RED'), ('small_ring'), ('/promo/'), ('absent_token'))
SELECT asset_id, ordinal, name FROM V WHERE EXISTS (SELECT 1 FROM t WHERE {_token("name", "token")})"""
UNMATCHED = f"""
WITH {V_SQL}, t(token) AS (VALUES ('RED'), ('small_ring'), ('absent_token'), ('100%'), ('_'))
SELECT token FROM t WHERE NOT EXISTS (SELECT 1 FROM V WHERE {_token("name", "token")})"""


def _reasons(name: str) -> list[tuple[str, str]]:
    low, base = f"lower({name})", f"regexp_extract({name}, '[^/]*$')"
    return [
        ("quality", _any(low, fixed.QA_PATTERNS)), ("bounds", _any(low, fixed.BOUNDS_PATTERNS)), ("crs", _any(low, fixed.CRS_PATTERNS)),
        ("own-dimension", f"list_contains(dims, {base})"), ("coordinate-name", f"lower({base}) IN {_in(fixed.COMMON_COORDINATES)}"),
        ("string-or-bool", "(contains(dtype, '|S') OR contains(dtype, '<U') OR contains(lower(dtype), 'bool'))"), ("scalar", "len(shape) = 0"),
    ]


_EXCLUDED = "(" + " OR ".join(t for _, t in _reasons("name")) + ")"


def ranked(frame: str) -> str:
    return f"R AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY len(shape) DESC, shape[1] * shape[2] * shape[3] DESC, name, ordinal) AS rank FROM {frame} WHERE NOT {_EXCLUDED})"


RANK = f"WITH {V_SQL}, {ranked('V')} SELECT asset_id, rank::INTEGER AS rank, ordinal, name FROM R WHERE rank <= 3"
EXCLUDED = (
    f"WITH {V_SQL}, W AS (SELECT ordinal, CASE ordinal % 8 WHEN 0 THEN concat('/quality', name) WHEN 1 THEN concat(name, '_bnds') WHEN 2 THEN '/g/lat' WHEN 3 THEN '/g/x' WHEN 4 THEN concat(name, '_CRS') ELSE name END AS name, dims, shape, dtype FROM V) "
    + " UNION ALL ".join(f"SELECT '{r}' AS reason, count(*) AS n FROM W WHERE {t} HAVING count(*) > 0" for r, t in _reasons("name"))
)
SELECTION = f"""
WITH {V_SQL}, n AS (SELECT asset_id, name, row_number() OVER (PARTITION BY asset_id ORDER BY ordinal) - 1 AS number FROM V),
a(asset_id, pos, part) AS (VALUES ('1', 0, '0'), ('1', 1, '2'), ('1', 2, 'ring'), ('1', 3, '99'))
SELECT a.asset_id, pos::INTEGER AS pos, coalesce(n.name, part) AS token FROM a LEFT JOIN n ON n.asset_id = a.asset_id AND try_cast(part AS BIGINT) = number
UNION ALL SELECT asset_id, number::INTEGER, name FROM n WHERE asset_id = '2'"""
INVENTORY_LINES = f"""
WITH {V_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ordinal) - 1 AS number FROM V)
SELECT asset_id, number::INTEGER AS number, concat(number, '  ', name, '  (', array_to_string(dims, ','), ')×(', array_to_string(shape, ','), ')  ', dtype) AS line FROM n"""
ELEMENTS = f"WITH {V_SQL} SELECT ordinal, shape[1] * shape[2] * shape[3] AS elements FROM V"

COUNT = "CASE WHEN chunks IS NOT NULL THEN (((shape[1] + chunks[1] - 1) // chunks[1]) * ((shape[2] + chunks[2] - 1) // chunks[2]) * ((shape[3] + chunks[3] - 1) // chunks[3]))::BIGINT END"
CHUNK_COUNT = f"WITH {V_SQL} SELECT ordinal, {COUNT} AS n_chunks FROM V"
ESTIMATE = f"WITH {V_SQL} SELECT ordinal, round(chunks[1] * chunks[2] * chunks[3] * ({ITEMSIZE}) / 2.0::DOUBLE / {MIB}::DOUBLE, 3) AS mb FROM V"


def grade(mb: str) -> str:
    return f"CASE WHEN {mb} IS NULL THEN 'unknown' WHEN {mb} < 1 THEN 'fail' WHEN {mb} < 4 THEN 'warn' WHEN {mb} <= 64 THEN 'pass' ELSE 'warn' END"


GRADES = f"WITH {S_SQL} SELECT {grade(f'(size_bytes / {MIB}::DOUBLE)')} AS grade, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM S GROUP BY 1"
SIZE_STATS = f"""WITH {S_SQL}, m AS (SELECT asset_id, size_bytes / {MIB}::DOUBLE AS mb FROM S)
SELECT asset_id, round(median(mb), 3) AS median_mb, round(min(mb), 3) AS min_mb, round(max(mb), 3) AS max_mb, count(*) AS n_sampled FROM m GROUP BY 1"""
PROFILES = f"""WITH {S_SQL}, p(profile, lo, hi) AS (VALUES ('interactive', 1, 4), ('training', 10, 100), ('agentic', 1, 16)), m AS (SELECT size_bytes / {MIB}::DOUBLE AS mb FROM S)
SELECT profile, CASE WHEN mb < lo THEN 'below' WHEN mb > hi THEN 'above' ELSE 'within' END AS status, count(*) AS n FROM m, p GROUP BY ALL"""

_GRIDS = """G AS (SELECT asset_id, name, ordinal, g1, g2, g3, g1 // 2 AS c1, g2 // 2 AS c2, g3 // 2 AS c3 FROM (
  SELECT asset_id, name, ordinal, (shape[1] + chunks[1] - 1) // chunks[1] AS g1, (shape[2] + chunks[2] - 1) // chunks[2] AS g2, (shape[3] + chunks[3] - 1) // chunks[3] AS g3 FROM V WHERE chunks IS NOT NULL))"""


def interior(most: int, radius: int) -> str:
    """Cells in a box that is wide enough for ``most`` of them, ordered by shell, squared distance and index."""
    axis = lambda i: f"LATERAL (SELECT unnest(range(greatest(0, c{i} - {radius}), least(g{i}, c{i} + {radius + 1}))) AS x{i}) AS a{i}"
    return f"""{_GRIDS},
I AS (SELECT asset_id, name, ordinal, x1, x2, x3, row_number() OVER (PARTITION BY ordinal ORDER BY greatest(abs(x1 - c1), abs(x2 - c2), abs(x3 - c3)), (x1 - c1) ** 2 + (x2 - c2) ** 2 + (x3 - c3) ** 2, x1, x2, x3) AS rank
  FROM G, {axis(1)}, {axis(2)}, {axis(3)} QUALIFY rank <= {most})"""


# Grids of V have one long axis at most or are wide in all, so small boxes hold enough cells; see the tests for others.
INTERIOR = f"WITH {V_SQL}, {interior(8, 8)} SELECT ordinal, rank::INTEGER AS rank, concat(x1, ',', x2, ',', x3) AS idx FROM I"
SCAN_INTERIOR = f"""
WITH {V_SQL}, {interior(32, 32)},
m AS (SELECT ordinal, rank, (x1 + x2 + x3) * 1000 + 1 AS size, (x1 + x2 + x3) % 2 <> 0 AS bears FROM I WHERE (x1 + x2 + x3) % 3 <> 0),
w AS (SELECT *, sum(size) OVER (PARTITION BY ordinal ORDER BY rank) <= 200000 AS within FROM m),
h AS (SELECT *, sum((bears AND within)::INTEGER) OVER (PARTITION BY ordinal ORDER BY rank) - (bears AND within)::INTEGER AS before FROM w),
s AS (SELECT ordinal, list(size ORDER BY rank) FILTER (within AND bears) AS good, list(size ORDER BY rank) FILTER (within) AS every, bool_or(NOT within) AS capped FROM h WHERE before < 4 GROUP BY 1),
f AS (SELECT DISTINCT ordinal FROM I)
SELECT f.ordinal, coalesce(len(coalesce(good, every[1:4])), 0)::BIGINT AS n_sizes, coalesce(list_sum(coalesce(good, every[1:4])), 0)::BIGINT AS bytes,
  CASE WHEN good IS NOT NULL THEN true WHEN s.ordinal IS NULL OR every IS NULL THEN NULL ELSE false END AS data_bearing
FROM f LEFT JOIN s USING (ordinal)"""
DATA_BEARING = """
SELECT vec_id, len(list_filter(embedding, lambda x: abs(x) < 0.05 * (vec_id % 9) OR x = 0)) / len(embedding) < 0.9 AS bears FROM embeddings"""

ORIENTATION_CASE = """CASE WHEN chunks IS NULL THEN 'unknown' WHEN ordinal % 3 = 2 THEN 'tiled'
  WHEN least(fy, fx) >= 0.5 AND (chunks[1] = 1 OR ft <= 0.1 * greatest(least(fy, fx), 1e-12)) THEN 'map-optimized'
  WHEN greatest(fy, fx) < 0.1 AND (chunks[1] >= 100 OR ft >= 0.5) THEN 'timeseries-optimized' ELSE 'balanced' END"""
_SHARES = "F AS (SELECT *, chunks[1] / shape[1] AS ft, chunks[2] / shape[2] AS fy, chunks[3] / shape[3] AS fx FROM V)"
ORIENTATION = f"WITH {V_SQL}, {_SHARES} SELECT ordinal, {ORIENTATION_CASE} AS orientation, ordinal % 3 = 1 AS hedged FROM F"
AMPLIFICATION = f"""
WITH {V_SQL}, q AS (SELECT ordinal, (shape[2] + chunks[2] - 1) // chunks[2] * ((shape[3] + chunks[3] - 1) // chunks[3]) AS map_chunks, (shape[1] + chunks[1] - 1) // chunks[1] AS series_chunks, 365 * ({ITEMSIZE}) AS needed FROM V WHERE chunks IS NOT NULL AND ordinal % 3 < 2)
SELECT ordinal, map_chunks, series_chunks, round(series_chunks * 2.0::DOUBLE * {MIB}::DOUBLE / needed, 2) AS series_amplification,
  CASE WHEN series_chunks * 2.0 * {MIB} / needed > 100 THEN 'fail' WHEN series_chunks * 2.0 * {MIB} / needed > 10 THEN 'warn' ELSE 'pass' END AS grade FROM q"""
COORDINATES = f"""
WITH {V_SQL} SELECT ordinal, coalesce(chunks IS NOT NULL AND ordinal % 3 <> 1 AND (shape[2] + chunks[2] - 1) // chunks[2] > 1 AND shape[2] * 8 / {MIB} < 8, false) AS noted FROM V"""

CODEC_GRAMMAR = f"""
WITH {V_SQL}, t AS (SELECT ordinal, CASE ordinal % 9 WHEN 0 THEN 'blosc7' WHEN 1 THEN 'zstd9' WHEN 2 THEN 'bloscn' WHEN 3 THEN 'none' ELSE coalesce(codec, 'none') END AS c FROM V),
x(c, family, cname, level, shuffle, status) AS (VALUES ('blosc7', 'blosc', 'zstd', 7, true, 'pass'), ('zstd9', 'zstd', NULL, 9, false, 'pass'), ('bloscn', 'blosc', 'lz4', 5, false, 'pass'), ('none', 'uncompressed', NULL, NULL, NULL, 'fail'),
  ('gzip+shuffle', 'zlib', NULL, 4, true, 'warn'), ('zstd-3', 'zstd', NULL, 3, false, 'pass'), ('blosc-lz4-5+shuffle', 'blosc', 'lz4', 5, true, 'pass'), ('lzf', 'exotic', NULL, NULL, NULL, 'warn'))
SELECT ordinal, family, cname, level::BIGINT AS level, shuffle, status FROM t JOIN x USING (c)"""
KEEPBITS = """
SELECT vec_id, CASE vec_id % 4 WHEN 2 THEN 23 ELSE greatest(0, least(23, ceil(log2(peak) - log2(e)) - 1)) END::BIGINT AS bits
FROM (SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS peak, CASE vec_id % 4 WHEN 0 THEN 0.001 WHEN 1 THEN 0.1 WHEN 2 THEN 1 ELSE 10 END::DOUBLE AS e FROM embeddings)"""

# --- conventions over K; names of K never are coordinates, containers or bounds but for the dimension rule
_COORD = f"(list_contains(dims, {NAME_BASE}) OR lower({NAME_BASE}) IN {_in(fixed.COMMON_COORDINATES)})"
_PLAIN = f"NOT {_COORD} AND lower({NAME_BASE}) NOT IN {_in(fixed.CRS_CONTAINERS)} AND NOT {_any(f'lower({NAME_BASE})', fixed.BOUNDS_PATTERNS)}"
_MET = f"EXISTS (SELECT 1 FROM K o WHERE o.asset_id = r.asset_id AND (o.name = r.ref OR {BASE.format('o.name')} = {BASE.format('r.ref')}))"


def _refs(attribute: str) -> str:
    return f"SELECT r.asset_id, {_MET} AS ok FROM (SELECT asset_id, unnest(string_split(\"{attribute}\", ' ')) AS ref FROM K WHERE \"{attribute}\" IS NOT NULL) r"


def _every(check: str, rows: str) -> str:
    return f"SELECT asset_id, '{check}' AS id, bool_and(ok) AS ok FROM ({rows}) GROUP BY asset_id"


_UNITS = _every("units_and_name", f"SELECT asset_id, units IS NOT NULL AND standard_name IS NOT NULL AS ok FROM K WHERE {_PLAIN}")
_COORDS = _every("coordinate_identification", _refs("coordinates"))
_GRIDMAP = _every("grid_mapping", _refs("grid_mapping"))
_BOUNDS = _every("bounds", _refs("bounds"))
_RANGE = "CASE dtype WHEN 'int16' THEN used BETWEEN -32768 AND 32767 WHEN 'uint8' THEN used BETWEEN 0 AND 255 ELSE true END"
_FILL = _every("fill_value_consistency", f'SELECT asset_id, CASE WHEN f <> m THEN false ELSE {_RANGE} END AS ok FROM (SELECT asset_id, dtype, "_FillValue"::INTEGER AS f, missing_value::INTEGER AS m, "_FillValue"::INTEGER AS used FROM K WHERE "_FillValue" IS NOT NULL)')
_SCALE = _every("scale_offset_typing", "SELECT asset_id, scale_factor = '0.1' AS ok FROM K WHERE scale_factor IS NOT NULL")
CF_UNITS, CF_COORDINATES, CF_GRID_MAPPING, CF_BOUNDS, CF_FILL, CF_SCALE = (f"WITH {K_SQL} {q}" for q in (_UNITS, _COORDS, _GRIDMAP, _BOUNDS, _FILL, _SCALE))
_CONVENTIONS = "SELECT asset_id, 'conventions_attr' AS id, coalesce(conventions, '') = 'CF-1.8' AS ok FROM A"
CF_ROWS = "C AS (" + " UNION ALL ".join([_CONVENTIONS, _UNITS, _COORDS, _GRIDMAP, _BOUNDS, _FILL, _SCALE]) + ")"
CF_STATUS = "CF AS (SELECT asset_id, CASE WHEN bool_and(ok) THEN 'pass' WHEN bool_or(ok) THEN 'warn' ELSE 'fail' END AS status, count(ok) AS applicable FROM C GROUP BY asset_id)"
CF_ROLLUP = f"WITH {K_SQL}, {A_SQL}, {CF_ROWS}, {CF_STATUS} SELECT * FROM CF"
# Without declared dimensions in odd assets no name is its own dimension there; names of K are not coordinates either way.
GEOZARR = f"""
WITH {K_SQL}, {A_SQL}, {CF_ROWS}, Z AS (SELECT * FROM C UNION ALL SELECT asset_id, 'consolidated_metadata', coalesce(consolidated, false) FROM A UNION ALL SELECT asset_id, 'dimension_names', bool_and(ordinal % 100 % 2 = 0) FROM K GROUP BY asset_id)
SELECT asset_id, CASE WHEN bool_and(ok) THEN 'pass' ELSE 'warn' END AS status, count(ok) AS applicable FROM Z GROUP BY asset_id"""
CRS = f"""
WITH {K_SQL}, refs AS (SELECT DISTINCT asset_id, grid_mapping AS ref FROM K WHERE grid_mapping IS NOT NULL),
hit AS (SELECT r.asset_id, coalesce((SELECT any_value(o.name) FROM K o WHERE o.asset_id = r.asset_id AND o.name = r.ref), (SELECT arg_min(o.name, o.ordinal) FROM K o WHERE o.asset_id = r.asset_id AND {BASE.format('o.name')} = {BASE.format('r.ref')})) AS name FROM refs r)
SELECT asset_id, ordinal, name FROM K WHERE lower({NAME_BASE}) IN {_in(fixed.CRS_CONTAINERS)} OR (asset_id, name) IN (SELECT (asset_id, name) FROM hit WHERE name IS NOT NULL)"""

# --- access
_CLASS = "CASE WHEN status_code IN (401, 403) THEN 'auth-required' WHEN status_code = 206 THEN 'ok' WHEN stage = 'range-get' THEN 'no-range-support' ELSE 'ok' END"
ACCESS = f"WITH {L_SQL} SELECT stage, status_code, {_CLASS} AS classification, count(*) AS n FROM L GROUP BY ALL"
ACCESS_COMBINED = f"""
WITH {L_SQL}, c AS (SELECT *, {_CLASS} AS c FROM L),
b AS (SELECT asset_id, arg_max(c, seq) FILTER (stage = 'head') AS h, arg_max(c, seq) FILTER (stage = 'range-get') AS r FROM c GROUP BY 1),
k AS (SELECT asset_id, CASE WHEN r = 'ok' THEN 'ok' WHEN h = 'auth-required' OR r = 'auth-required' THEN 'auth-required' ELSE r END AS k FROM b)
SELECT asset_id, 'D1-range' AS id, CASE k WHEN 'ok' THEN 'pass' WHEN 'no-range-support' THEN 'warn' ELSE 'skipped' END AS status, concat('probe: ', coalesce(k, 'none')) AS evidence FROM k"""
STORE_ERRORS = f"""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'credentials-endpoint-auth' WHEN 1 THEN 'in-region-only' ELSE 'unknown' END AS kind,
  CASE WHEN page_id % 5 IN (0, 2) THEN {_any("lower(url)", fixed.ARCHIVE_MARKERS)} ELSE page_id % 5 = 4 END AS archive,
  CASE WHEN page_id % 5 IN (0, 2) THEN {"CASE " + " ".join(f"WHEN contains(lower(url), '{h}') THEN '{n}'" for h, n in fixed.ARCHIVE_OF) + " END"} WHEN page_id % 5 = 4 THEN 'LPDAAC' END AS short_name FROM pages"""
_RUN = "T AS (SELECT *, sum(bytes) OVER (PARTITION BY asset_id ORDER BY seq)::BIGINT AS total_bytes, count(*) OVER (PARTITION BY asset_id ORDER BY seq) AS requests FROM L)"
BREACHES = f"""WITH {L_SQL}, {_RUN} SELECT asset_id, seq, total_bytes, requests FROM T WHERE total_bytes > 1000000 QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY seq) = 1"""
RUNNING = f"""WITH {L_SQL}, {_RUN} SELECT asset_id, seq, bytes, total_bytes, requests, row_number() OVER (PARTITION BY asset_id ORDER BY bytes DESC, seq) AS place FROM T QUALIFY place <= 5"""

# --- scoring over A, K and the findings made of L
_ID = "CASE seq % 7 WHEN 0 THEN 'D1-range' WHEN 1 THEN 'D2-auth' WHEN 2 THEN 'D0' WHEN 3 THEN 'D3-https-cors' ELSE 'other' END"
_FIND = f"""N AS (SELECT asset_id, {_ID} AS id, arg_min(CASE seq % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'partial' WHEN 2 THEN 'fail' ELSE 'skipped' END, seq) AS status, concat('e', min(seq)) AS evidence FROM L GROUP BY 1, 2)"""
_MB = f"round((CASE WHEN chunks IS NOT NULL THEN chunks[1] * chunks[2] * chunks[3] ELSE shape[1] * shape[2] * shape[3] END) * ({ITEMSIZE}) / 2.0::DOUBLE / {MIB}::DOUBLE, 3)"
_SEL = f"{ranked('K')}, X AS (SELECT asset_id, {grade(_MB)} AS grade, CASE WHEN {_MB} BETWEEN 1 AND 16 THEN 'within' ELSE 'out' END AS agentic, {COUNT} AS n_chunks, codec FROM R WHERE rank = 1)"
_INV = "W AS (SELECT asset_id, count(chunks) AS n_chunked, coalesce(bool_or(chunks IS NOT NULL AND size_bytes / (shape[1] * shape[2] * shape[3]) * (chunks[1] * chunks[2] * chunks[3]) < 1000000), false) AS tiny, arg_min(coalesce(codec, ''), ordinal) AS codec0, bool_or(coalesce(units, standard_name, grid_mapping, bounds, coordinates, \"_FillValue\", missing_value, scale_factor) IS NOT NULL) AS any_attrs FROM K GROUP BY 1)"
_CRS_N = CRS.split("refs AS", 1)[1]
_FACTS = f"""refs AS {_CRS_N.replace("SELECT asset_id, ordinal, name FROM K", "  , H AS (SELECT DISTINCT asset_id FROM K").strip()}),
Y AS (SELECT A.*, W.n_chunked, W.tiny, W.codec0, coalesce(W.any_attrs, false) AS any_attrs, X.grade, X.agentic, X.n_chunks, X.codec, X.asset_id IS NOT NULL AS picked, CF.status AS cf, H.asset_id IS NOT NULL AS crs_found,
    coalesce((SELECT ok FROM C WHERE C.asset_id = A.asset_id AND id = 'grid_mapping'), false) AS mapped
  FROM A JOIN W USING (asset_id) LEFT JOIN X USING (asset_id) LEFT JOIN CF USING (asset_id) LEFT JOIN H USING (asset_id))"""
_NATIVE, _OPT, _HOSTILE = _in(fixed.CLOUD_NATIVE), _in(fixed.CLOUD_OPTIMIZABLE), _in(fixed.CLOUD_HOSTILE)
_B1 = """CASE WHEN requests_to_open <= 3 THEN 'pass' WHEN requests_to_open <= 10 THEN 'partial' WHEN requests_to_open IS NOT NULL THEN 'fail' WHEN format IN ('cog', 'parquet') THEN 'pass' WHEN format = 'zarr' AND consolidated THEN 'pass' WHEN format = 'netcdf3' THEN 'fail' ELSE 'skipped' END"""
_A = f"""greatest(0, least(30, CASE WHEN format IN {_NATIVE} THEN 26 WHEN format IN {_OPT} THEN 14 WHEN format IN {_HOSTILE} THEN 4 ELSE 10 END
  + CASE WHEN format = 'cog' THEN CASE WHEN codec0 IN ('', 'none') THEN -2 ELSE 0 END WHEN format IN ('zarr', 'icechunk', 'kerchunk') THEN CASE consolidated WHEN true THEN 4 WHEN false THEN -4 ELSE 0 END
    WHEN format = 'hdf5' THEN CASE WHEN n_chunked = 0 THEN -6 WHEN tiny THEN -4 ELSE 4 END ELSE 0 END))"""
_B4 = "(1.5 + CASE WHEN cf IN ('pass', 'warn') THEN 1.5 ELSE 0 END + CASE WHEN any_attrs THEN 1 ELSE 0 END)"
_C3 = "CASE WHEN NOT picked THEN 'skipped' WHEN agentic = 'within' AND b1 = 'pass' THEN 'pass' WHEN agentic = 'within' AND b1 = 'partial' THEN 'partial' WHEN agentic <> 'within' AND b1 = 'pass' THEN 'mixed' ELSE 'fail' END"
_GRADE_STATUS = "CASE WHEN NOT picked OR grade = 'unknown' THEN 'skipped' WHEN grade = 'warn' THEN 'partial' ELSE grade END"
_CODEC_STATUS = f"CASE WHEN NOT picked THEN 'skipped' WHEN codec IS NULL THEN 'fail' WHEN regexp_matches(codec, 'gzip|zlib|deflate') THEN 'partial' WHEN regexp_matches(codec, 'zstd|blosc') THEN 'pass' ELSE 'partial' END"


def _points(status: str, **by: float) -> str:
    names = {"na": "n/a"}
    return f"CASE {status} " + " ".join(f"WHEN '{names.get(k, k)}' THEN {v}" for k, v in by.items()) + " END"


def _d(cid: str, points: int) -> str:
    status = f"coalesce((SELECT status FROM N WHERE N.asset_id = Z.asset_id AND id = '{cid}'), 'skipped')"
    return f"SELECT asset_id, {[c for c, _, _ in fixed.CHECKS].index(cid)} AS seq, '{cid}' AS id, 'D' AS dimension, {points} AS points_possible, {_points(status, **{'pass': points, 'partial': points / 2, 'skipped': points / 2, 'fail': 0})} AS points_awarded, {status} AS status FROM Z"


def _e(cid: str, points: int, test: str) -> str:
    status = f"CASE WHEN NOT has_cmr THEN 'skipped' WHEN {test} THEN 'pass' ELSE 'fail' END"
    return f"SELECT asset_id, {[c for c, _, _ in fixed.CHECKS].index(cid)}, '{cid}', 'E', {points}, {_points(status, **{'skipped': points / 2, 'pass': points, 'fail': 0})}, {status} FROM Z"


_RAN = "smoke_status IN ('pass', 'fail')"
_CRS_OK = "(crs_found OR mapped)"
_E7 = "CASE WHEN NOT has_cmr THEN 'skipped' WHEN cmr_keywords >= 3 THEN 'pass' WHEN cmr_keywords > 0 THEN 'partial' ELSE 'fail' END"
_TAG, _STRONG, _ICE = "etag IS NOT NULL", "(etag IS NOT NULL AND NOT starts_with(etag, 'W/'))", "format = 'icechunk'"
_CHECK_ROWS = " UNION ALL ".join([
    "SELECT asset_id, 0 AS seq, 'A-class' AS id, 'A' AS dimension, 30 AS points_possible, a AS points_awarded, CASE WHEN a >= 22 THEN 'pass' WHEN a >= 10 THEN 'partial' ELSE 'fail' END AS status FROM Z",
    "SELECT asset_id, 1, 'B1-open', 'B', 8, CASE WHEN requests_to_open <= 3 THEN 8 WHEN requests_to_open <= 10 THEN 5 WHEN requests_to_open IS NOT NULL THEN 1 WHEN format IN ('cog', 'parquet') THEN 7 WHEN format = 'zarr' AND consolidated THEN 8 WHEN format = 'netcdf3' THEN 1 ELSE 4 END, b1 FROM Z",
    f"SELECT asset_id, 2, 'B2-crs', 'B', 3, CASE WHEN {_CRS_OK} THEN 3 WHEN {_RAN} THEN 0 ELSE 1.5 END, CASE WHEN {_CRS_OK} THEN 'pass' WHEN {_RAN} THEN 'fail' ELSE 'skipped' END FROM Z",
    "SELECT asset_id, 3, 'B3-semantics', 'B', 5, CASE cf WHEN 'pass' THEN 5 WHEN 'warn' THEN 3 WHEN 'fail' THEN 1 ELSE 2.5 END, CASE cf WHEN 'pass' THEN 'pass' WHEN 'warn' THEN 'partial' WHEN 'fail' THEN 'fail' ELSE 'skipped' END FROM Z",
    f"SELECT asset_id, 4, 'B4-catalog', 'B', 4, {_B4}, CASE WHEN {_B4} >= 3 THEN 'pass' ELSE 'partial' END FROM Z",
    f"SELECT asset_id, 5, 'C1-interactive', 'C', 5, {_points('g', **{'skipped': 2.5, 'pass': 5, 'fail': 0, 'partial': 2})}, g FROM Z",
    f"SELECT asset_id, 6, 'C2-training', 'C', 7, {_points('g', **{'skipped': 3.5, 'pass': 7, 'fail': 0, 'partial': 2.8})}, g FROM Z",
    f"SELECT asset_id, 7, 'C3-agentic', 'C', 7, {_points('c3', **{'skipped': 3.5, 'pass': 7, 'partial': 4.2, 'mixed': 2.8, 'fail': 1})}, replace(c3, 'mixed', 'partial') FROM Z",
    "SELECT asset_id, 8, 'C4-count', 'C', 3, CASE WHEN n_chunks IS NULL THEN 1.5 WHEN n_chunks < 1000000 THEN 3 ELSE 0 END, CASE WHEN n_chunks IS NULL THEN 'skipped' WHEN n_chunks < 1000000 THEN 'pass' ELSE 'fail' END FROM Z",
    f"SELECT asset_id, 9, 'C5-codec', 'C', 3, {_points('c5', **{'skipped': 1.5, 'pass': 3, 'fail': 0, 'partial': 1.8})}, c5 FROM Z",
    *[_d(c, p) for c, d, p in fixed.CHECKS if d == "D"],
    f"SELECT asset_id, 14, 'E1-version', 'E', 2, CASE WHEN {_ICE} THEN 2 WHEN {_TAG} THEN 1 ELSE 0.5 END, CASE WHEN {_ICE} THEN 'pass' WHEN {_TAG} THEN 'partial' ELSE 'fail' END FROM Z",
    f"SELECT asset_id, 15, 'E2-checksums', 'E', 2, CASE WHEN {_ICE} THEN 2 WHEN {_STRONG} THEN 1 ELSE 0 END, CASE WHEN {_ICE} THEN 'pass' WHEN {_STRONG} THEN 'partial' ELSE 'fail' END FROM Z",
    _e("E3-license", 2, "cmr_license"), _e("E4-citation", 1, "false"), _e("E5-contact", 1, "cmr_contact"), _e("E6-usage", 1, "false"),
    f"SELECT asset_id, 20, 'E7-applications', 'E', 1, {_points('e7', **{'skipped': 0.5, 'pass': 1, 'partial': 0.5, 'fail': 0})}, e7 FROM Z",
])
_ALL = f"""WITH {K_SQL}, {L_SQL}, {A_SQL}, {CF_ROWS}, {CF_STATUS}, {_FIND}, {_SEL}, {_INV}, {_FACTS},
Z0 AS (SELECT *, {_A} AS a, {_B1} AS b1, {_GRADE_STATUS} AS g, {_CODEC_STATUS} AS c5, {_E7} AS e7 FROM Y), Z AS (SELECT *, {_C3} AS c3 FROM Z0),
Q0 AS ({_CHECK_ROWS}),
Q AS (SELECT asset_id, seq::BIGINT AS seq, id, dimension, points_possible::DOUBLE AS points_possible, round(points_awarded::DOUBLE, 1) AS points_awarded, status FROM Q0)"""
CHECKS_ALL = f"{_ALL} SELECT * FROM Q"
D_CHECKS = f"""{_ALL} SELECT Q.asset_id, Q.id, Q.status, points_awarded, coalesce(N.evidence, 'not verified live: ' || Z9.evidence, 'not verified live') AS evidence
FROM Q LEFT JOIN N ON N.asset_id = Q.asset_id AND N.id = Q.id LEFT JOIN N Z9 ON Z9.asset_id = Q.asset_id AND Z9.id = 'D0' WHERE dimension = 'D'"""
_WEIGHTS = "(VALUES " + ", ".join(f"('{d}', {w}::DOUBLE)" for d, w, _ in fixed.DIMENSIONS) + ") AS w(dimension, weight)"
_DIMS = f"""DS AS (SELECT i.asset_id, w.dimension, w.weight, round(coalesce(sum(points_awarded) / nullif(sum(points_possible), 0) * any_value(w.weight), 0), 1) AS score
  FROM (SELECT DISTINCT asset_id FROM Q) i CROSS JOIN {_WEIGHTS} LEFT JOIN Q ON Q.asset_id = i.asset_id AND Q.dimension = w.dimension AND Q.status <> 'n/a' GROUP BY i.asset_id, w.dimension, w.weight)"""
DIMENSIONS = f"{_ALL}, {_DIMS} SELECT * FROM DS"
GROUPING_SETS = f"{_ALL} SELECT asset_id, dimension, round(sum(points_awarded), 4) AS got, sum(points_possible) AS possible, count(*) AS n FROM Q WHERE status <> 'n/a' GROUP BY ROLLUP (asset_id, dimension)"
SCORES = f"""{_ALL}, {_DIMS},
P AS (SELECT asset_id, {", ".join(f"max(score) FILTER (dimension = '{d}') AS dim_{d.lower()}" for d, _, _ in fixed.DIMENSIONS)}, round(sum(score), 1) AS raw FROM DS GROUP BY 1),
O AS (SELECT asset_id, count(*) FILTER (status = 'skipped') AS n_skipped, count(*) FILTER (status IN ('partial', 'fail')) AS gaps, bool_or(status = 'fail' AND id IN {_in(fixed.CONSUMER_VISIBLE)}) AS blocked FROM Q GROUP BY 1),
U AS (SELECT P.*, n_skipped, gaps, blocked OR smoke_status = 'fail' AS stopped, CASE WHEN (blocked OR smoke_status = 'fail') AND raw > 74 THEN 74 ELSE raw END AS score FROM P JOIN O USING (asset_id) JOIN A USING (asset_id))
SELECT asset_id, dim_a, dim_b, dim_c, dim_d, dim_e, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 35 THEN 'D' ELSE 'F' END AS tier,
  CASE WHEN stopped THEN 'NOT READY' WHEN gaps > 0 THEN 'READY WITH CAVEATS' ELSE 'READY' END AS verdict, CASE WHEN n_skipped = 0 THEN 'High' WHEN n_skipped <= 3 THEN 'Reduced' ELSE 'Low' END AS confidence, n_skipped FROM U"""
REMEDIATIONS = f"""{_ALL} SELECT asset_id, (row_number() OVER (PARTITION BY asset_id ORDER BY points_possible DESC, seq))::INTEGER AS rank, id, points_possible FROM Q WHERE status IN ('partial', 'fail')"""

CMR = """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'CC0' END AS license, CASE WHEN doc_id % 2 = 0 THEN concat('10.1/', doc_id) END AS doi, (doc_id % 4 = 3)::BIGINT AS n_docs, doc_id % 5 AS n_keywords, length(source)::BIGINT AS description_len,
  concat('s3://b/', doc_id) AS s3_url, (doc_id % 4 >= 1)::BIGINT AS n_https, CASE WHEN doc_id % 4 >= 2 THEN 'https://h/S3credentials/' END AS credentials_url FROM documents"""

# --- the scorecard of the Parquet files themselves: what does not vary between them is stated as numbers
_PNAME = "replace(path_in_schema, ', ', '.')"
ASSET_SCORECARD = f"""
WITH P AS (SELECT regexp_extract(file_name, '[^/]*$') AS asset_id, {_PNAME} AS name, min(column_id) AS ordinal, sum(row_group_num_rows) AS n, any_value(CASE WHEN contains(path_in_schema, ',') THEN 8 WHEN type = 'INT32' THEN 4 WHEN type = 'BOOLEAN' THEN 1 ELSE 8 END) AS width, any_value(type) AS type
  FROM parquet_metadata('{FOOTERS}') GROUP BY 1, 2),
R AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, name, ordinal) AS rank FROM P WHERE type <> 'BOOLEAN' AND NOT ({" OR ".join(t for r, t in _reasons("name") if r in ("quality", "bounds", "crs", "coordinate-name"))})),
G AS (SELECT asset_id, round(n * width / 2.0::DOUBLE / {MIB}::DOUBLE, 3) AS mb FROM R WHERE rank = 1),
H AS (SELECT asset_id, {grade("mb")} AS g, mb BETWEEN 1 AND 16 AS fits FROM G),
D AS (SELECT asset_id, g, round(CASE g WHEN 'pass' THEN 12 WHEN 'fail' THEN 0 ELSE 4.8 END + CASE WHEN fits THEN 7 ELSE 2.8 END + 1.5 + 1.8, 1)::DOUBLE AS dim_c FROM H),
T AS (SELECT *, round(26 + 12 + dim_c + 7.5 + 3.5, 1) AS raw FROM D),
U AS (SELECT *, CASE WHEN g = 'fail' AND raw > 74 THEN 74 ELSE raw END AS score FROM T)
SELECT asset_id, 26.0::DOUBLE AS dim_a, 12.0::DOUBLE AS dim_b, dim_c, 7.5::DOUBLE AS dim_d, 3.5::DOUBLE AS dim_e, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 35 THEN 'D' ELSE 'F' END AS tier,
  CASE WHEN g = 'fail' THEN 'NOT READY' ELSE 'READY WITH CAVEATS' END AS verdict, 'Low' AS confidence FROM U"""

RESOLVE = """
WITH p AS (SELECT page_id, page_id % 4 AS k, page_id % 3 AS c, page_id % 8 = 1 AS known, url FROM pages)
SELECT page_id::VARCHAR AS asset_id, CASE k WHEN 1 THEN 'granule-id' WHEN 2 THEN 'local' ELSE 'url' END AS input_kind,
  CASE WHEN k = 2 THEN 'local' WHEN k = 1 AND known THEN 'credentials' WHEN k = 1 THEN 'error' WHEN c = 2 THEN 'error' ELSE 'anonymous' END AS auth,
  CASE k WHEN 0 THEN url WHEN 1 THEN CASE WHEN known THEN 's3://g/' || page_id ELSE 'G' || page_id || '-P' END WHEN 2 THEN '/d/' || page_id ELSE 's3://b/' || page_id END AS url,
  CASE WHEN k = 2 THEN 'D0-hosting=skipped' WHEN k = 1 AND NOT known THEN 'D2-auth=fail'
    ELSE 'D1-range=' || CASE c WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' ELSE 'skipped' END || CASE WHEN k = 1 THEN ';D2-auth=pass' ELSE '' END END AS findings FROM p"""
STORES = """
SELECT doc_id::VARCHAR AS asset_id, CASE WHEN doc_id % 6 < 4 THEN 'zarr' WHEN doc_id % 6 = 4 THEN 'icechunk' ELSE 'unknown' END AS format,
  CASE WHEN doc_id % 6 < 2 THEN 'v3' WHEN doc_id % 6 < 4 THEN 'v2' END AS zarr_version, CASE doc_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS consolidated FROM documents"""
