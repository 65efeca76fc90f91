"""Names, thresholds, tables and formats that decide results. They are stated here and nowhere else."""

# --- input and format detection
URL_SCHEMES = ("http", "https", "s3", "gs", "az", "abfs")
GRANULE_ID = r"^G\d+-[A-Z0-9_.]+$"

EXTENSIONS = {
    ".tif": "cog", ".tiff": "cog", ".cog": "cog", ".zarr": "zarr",
    ".h5": "hdf5", ".hdf5": "hdf5", ".he5": "hdf5", ".hdf": "hdf4", ".hdf4": "hdf4", ".he2": "hdf4",
    ".nc": "netcdf-unknown", ".nc4": "hdf5", ".cdf": "netcdf-unknown",
    ".parquet": "parquet", ".geoparquet": "parquet", ".fgb": "flatgeobuf",
    ".laz": "las", ".las": "las", ".copc.laz": "copc", ".pmtiles": "pmtiles",
    ".grib": "grib2", ".grib2": "grib2", ".grb": "grib2", ".grb2": "grib2",
    ".shp": "shapefile", ".csv": "csv", ".txt": "csv", ".zip": "zip", ".tar": "tar", ".gz": "gzip", ".tgz": "tar",
    ".json": "json", ".jsonld": "json",
}

CLOUD_NATIVE = ("cog", "zarr", "icechunk", "parquet", "copc", "flatgeobuf", "pmtiles")
CLOUD_OPTIMIZABLE = ("hdf5", "netcdf4", "las", "kerchunk")
CLOUD_HOSTILE = ("netcdf3", "grib2", "shapefile", "csv", "zip", "tar", "gzip", "hdf4")

#: Leading bytes and format, in the order in which they are tried: fixed values of the formats.
MAGIC_FIRST = ((b"\x89HDF\r\n\x1a\n", "hdf5"), (b"CDF\x01", "netcdf3"), (b"CDF\x02", "netcdf3"), (b"CDF\x05", "netcdf3"), (b"\x0e\x03\x13\x01", "hdf4"))
HDF5_MAGIC, HDF5_LATER_OFFSETS = b"\x89HDF\r\n\x1a\n", (512, 1024, 2048, 4096)
MAGIC_LATER = (
    (b"PAR1", "parquet"),
    (b"II*\x00", "cog"), (b"MM\x00*", "cog"), (b"II+\x00", "cog"), (b"MM\x00+", "cog"),
    (b"GRIB", "grib2"), (b"fgb", "flatgeobuf"), (b"LASF", "las"), (b"PMTiles", "pmtiles"), (b"PK\x03\x04", "zip"), (b"\x1f\x8b", "gzip"),
)
TAR_MAGIC, TAR_OFFSET, SHAPEFILE_MAGIC = b"ustar", 257, b"\x00\x00\x27\x0a"
HEAD_BYTES = 16 * 1024

# --- variable names
QA_PATTERNS = ("qa", "flag", "quality", "mask")
BOUNDS_PATTERNS = ("bnds", "bounds")
CRS_PATTERNS = ("crs", "projection", "spatial_ref")
COMMON_COORDINATES = ("time", "lat", "latitude", "lon", "longitude", "x", "y", "z", "level", "lev", "plev", "depth", "height")
CRS_CONTAINERS = ("projection", "crs", "spatial_ref")

TIME_NAMES = ("time", "t", "date", "step", "epoch")
VERTICAL_NAMES = ("level", "lev", "plev", "z", "depth", "height", "alt", "altitude")
Y_NAMES = ("lat", "latitude", "y", "northing", "rows")
X_NAMES = ("lon", "longitude", "x", "easting", "cols", "columns")

# --- chunk geometry
MIB = 1048576
GRADE_FAIL_BELOW, GRADE_WARN_BELOW, GRADE_PASS_TO, GRADE_LEAN_TO = 1.0, 4.0, 16.0, 64.0
ASSUMED_RATIO = 2.0
PROFILES = {"interactive": (1.0, 4.0), "training": (10.0, 100.0), "agentic": (1.0, 16.0)}
SPATIAL_LARGE, SPATIAL_SMALL, TIME_STEPS, TIME_SHARE, TIME_THIN = 0.5, 0.1, 100, 0.5, 0.1
AMPLIFICATION_WARN, AMPLIFICATION_FAIL = 10.0, 100.0
PLACEHOLDER_ITEMSIZE = 8
INTERIOR_SAMPLES, INTERIOR_CANDIDATES = 8, 32
FILL_SHARE = 0.9
COORDINATE_MB = 8

#: Bytes of one element by type name; every other name counts as 8.
ITEMSIZES = {
    "bool": 1, "int8": 1, "uint8": 1, "int16": 2, "uint16": 2, "float16": 2, "int32": 4, "uint32": 4, "float32": 4,
    "int64": 8, "uint64": 8, "float64": 8, "double": 8, "float": 8, "complex64": 8, "complex128": 16,
}

# --- codecs
UNCOMPRESSED = ("none", "uncompressed", "raw", "", "no compression")
WEAK_CODECS, MODERN_CODECS = "gzip|zlib|deflate", "zstd|blosc"
ZSTD_LEVELS, BLOSC_VARIANTS = (1, 3, 5), (("lz4", 5), ("zstd", 3))
MIN_SAMPLE_BYTES = 64 * 1024
MANTISSA_BITS = {"float16": 10, "float32": 23, "float64": 52}

# --- access
AUTH_CODES = (401, 403)
AUTH_MARKERS = ("401", "403", "unauthorized", "forbidden", "accessdenied")
LOGIN_MARKERS = ("urs.earthdata.nasa.gov", "urs-redirect", "earthdata-login", "earthdata login")
ARCHIVE_MARKERS = ("earthdatacloud", "daac", "cumulus", "podaac", "lpdaac", "gesdisc", "nsidc", "asf", "ornl", "ghrc", "laads", "obdaac", "nisar", "opera")
ARCHIVE_OF = (
    ("podaac", "PODAAC"), ("lpdaac", "LPDAAC"), ("ornl", "ORNLDAAC"), ("nsidc", "NSIDC"), ("nisar", "ASF"),
    ("asf", "ASF"), ("gesdisc", "GES_DISC"), ("ghrc", "GHRCDAAC"), ("laads", "LAADS"), ("obdaac", "OBDAAC"),
)
CREDENTIAL_MARKERS = ("urs.earthdata", "s3credentials", "earthdata login")
CREDENTIAL_STATUS = ("401", "403", "unauthorized")
DENIAL_MARKERS = ("accessdenied", "access denied", "forbidden")
RANGE_STATUS = {"ok": "pass", "no-range-support": "warn", "auth-required": "skipped", "not-assessable": "skipped"}

# --- budgets
PRIORITY_GROUPS = ("identification", "metadata")
MAX_BYTES, MAX_SECONDS, MAX_OBJECTS, MAX_ATTRS = 25 * 1024 * 1024, 60, 5000, 10

# --- rubric
DIMENSIONS = (("A", 30, "Format & structure"), ("B", 20, "Metadata locality & richness"), ("C", 25, "Chunking & AI-workflow fit"), ("D", 15, "Access & transport"), ("E", 10, "Reproducibility & governance"))
TIERS = ((90.0, "A"), (75.0, "B"), (55.0, "C"), (35.0, "D"))
CHECKS = (
    ("A-class", "A", 30), ("B1-open", "B", 8), ("B2-crs", "B", 3), ("B3-semantics", "B", 5), ("B4-catalog", "B", 4),
    ("C1-interactive", "C", 5), ("C2-training", "C", 7), ("C3-agentic", "C", 7), ("C4-count", "C", 3), ("C5-codec", "C", 3),
    ("D1-range", "D", 6), ("D2-auth", "D", 3), ("D3-https-cors", "D", 3), ("D4-cleanpath", "D", 3),
    ("E1-version", "E", 2), ("E2-checksums", "E", 2), ("E3-license", "E", 2), ("E4-citation", "E", 1), ("E5-contact", "E", 1), ("E6-usage", "E", 1), ("E7-applications", "E", 1),
)
CONSUMER_VISIBLE = ("C1-interactive", "C2-training", "D1-range")
CAP = 74.0
MAX_CHUNKS = 1_000_000
FRONT_LOADED = ("cog", "parquet", "pmtiles", "flatgeobuf", "copc")
STATUS_LABELS = {"pass": "PASS", "partial": "WARN", "fail": "FAIL", "skipped": "SKIPPED", "n/a": "N-A"}
STATUS_MARKS = {"pass": "\u2705", "partial": "\u26a0\ufe0f", "fail": "\u274c", "skipped": "\u2754"}
#: Ways of use, the check that judges each, the advice of the report, and the reads it should take.
PROFILE_ROWS = (
    ("Interactive / visualization", "C1-interactive", "chunks or tiles of 1 to 4 MB, with overviews", "1 for a tile on screen"),
    ("AI training (throughput)", "C2-training", "chunks or shards of 10 to 100 MB, best 32 to 64, cut like the samples", "1 or 2 for a batch of 64 MB"),
    ("AI agentic", "C3-agentic", "chunks of 1 to 16 MB, the schema in one read, addresses that stay", "3 at most from catalogue to subset"),
)
