"""Readers: tables, manifests, telemetry lines, predictions, metric files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from crosswin.functions.expr import to_double
from crosswin.operators.scale import attach, first_per_key

MANIFEST_SCHEMA = "family string, canon_stem string, pcap_path string, txt_path string"


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Parquet, CSV (with header) or JSON lines, by the ending of the path."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    low = path.lower().rstrip("/*")
    if low.endswith((".csv", ".csv.gz")):
        return reader.option("header", True).csv(path)
    if low.endswith((".json", ".jsonl", ".json.gz")):
        return reader.json(path)
    return reader.parquet(path)


def keep_runs(flows: DataFrame, manifest: DataFrame, columns: list[str] | None = None, key: str = "run_id") -> DataFrame:
    """Rows whose run is in the manifest, and only the wanted columns (the key always stays)."""
    if columns is not None:
        flows = flows.select(key, *[c for c in columns if c in flows.columns and c != key])
    ids = manifest.select(F.col("run_id").cast("string").alias(key)).distinct()
    return attach(flows.withColumn(key, F.col(key).cast("string")), ids, key, "left_semi")


def read_flows(spark: SparkSession, path: str, manifest: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Flow table filtered to the manifest; ``pcap_id`` becomes ``run_id``."""
    raw = read_table(spark, path)
    if "pcap_id" not in raw.columns:
        raise ValueError("the flow table has no pcap_id column")
    return keep_runs(raw.withColumnRenamed("pcap_id", "run_id"), manifest, columns)


def manifest(rows: DataFrame) -> DataFrame:
    """One row per run from a paired-run list that carries ``ord``, its line order."""
    missing = {"family", "canon_stem", "pcap_path", "txt_path"} - set(rows.columns)
    if missing:
        raise ValueError(f"manifest lacks columns: {sorted(missing)}")
    named = rows.select(F.col("canon_stem").cast("string").alias("run_id"), "ord", "family", "pcap_path", "txt_path")
    return first_per_key(named, ["run_id"], ["ord"]).drop("ord")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest from a CSV file, its lines kept in file order.

    The reader's task order gives the line order; a manifest is a short list of runs.
    """
    rows = read_table(spark, path, MANIFEST_SCHEMA)
    return manifest(rows.withColumn("ord", F.monotonically_increasing_id()))


# ---- telemetry ---------------------------------------------------------------------------

CORE_FIELDS = ("timestamp", "ts", "ue_id", "dlBytes", "ulBytes")
LEFT_OUT = ("pmi",)  # fixed value: never a field of a record
MOST_FIELDS = 1000


def telemetry_fields(lines: DataFrame, text: str = "value") -> list[str]:
    """Names of all keys that the records hold, besides the core fields; too many fail."""
    objects = lines.where(F.trim(text).startswith("{") & F.trim(text).endswith("}"))
    names = objects.select(F.explode(F.json_object_keys(F.trim(text))).alias("k")).distinct().limit(MOST_FIELDS + 1)
    found = sorted(r["k"] for r in names.collect())
    if len(found) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} different keys; name the fields to read")
    return [k for k in found if k not in CORE_FIELDS and k not in LEFT_OUT]


def telemetry_schema(kpis: list[str]) -> T.StructType:
    """Record schema; everything is read as text and coerced later."""
    return T.StructType([T.StructField(n, T.StringType()) for n in (*CORE_FIELDS, *kpis)])


def parse_lines(lines: DataFrame, schema: T.StructType, text: str = "value") -> DataFrame:
    """JSON objects of the lines; lines that hold no object are dropped without a trace."""
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rec = F.from_json(F.trim(text), with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    keep = [c for c in lines.columns if c != text]
    return (
        lines.where(F.trim(text).startswith("{") & F.trim(text).endswith("}"))
        .withColumn("_rec", rec)
        .where(F.col("_rec").isNotNull() & F.col("_rec._bad").isNull())
        .select(*keep, *[F.col(f"_rec.{f.name}").alias(f.name) for f in schema.fields])
    )


def read_telemetry(
    spark: SparkSession, path: str, ts_keys: tuple[str, ...] = ("timestamp", "ts"), fields: list[str] | None = None
) -> DataFrame:
    """Strict telemetry read: one file per run, ``run_id`` from the file name, line order kept.

    All keys of all records become columns, unless ``fields`` names those wanted.

    Lines of a file come from one or more splits; the offset order of the splits and the row
    order inside them make the line order, so ``ord`` increases along each file.
    """
    raw = spark.read.text(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.[^./]*$", 1).alias("run_id"),
        (F.col("_metadata.file_block_start") * F.lit(1 << 20).cast("bigint")
         + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))).alias("ord"),
        "value",
    )
    names = telemetry_fields(raw) if fields is None else fields
    return pick_timestamp(parse_lines(raw, telemetry_schema(names)), ts_keys)


def pick_timestamp(records: DataFrame, ts_keys: tuple[str, ...] = ("timestamp", "ts")) -> DataFrame:
    """Per run, take the timestamp key that the earliest record carrying any of them uses.

    Adds ``ts_raw`` (bigint, null where the value is no number).
    """
    keys = [k for k in ts_keys if k in records.columns]
    which = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in keys])
    first = (
        records.where(which.isNotNull())
        .groupBy("run_id")
        .agg(F.min_by(which, "ord").alias("_ts_key"))
    )
    value = F.coalesce(*[F.when(F.col("_ts_key") == k, F.col(k)) for k in keys])
    return (
        attach(records, first, "run_id")
        .withColumn("ts_raw", to_double(value).cast("bigint"))
        .drop("_ts_key", *keys)
    )


def lenient_records(lines: DataFrame, text: str = "value") -> DataFrame:
    """Records from decorated lines: trailing comma, byte-string wrapper, text around the
    braces, single quotes, keys in any case and under their alternative names. Of keys that
    differ in case only, the last one counts.

    Adds ``parse_error`` (1 for a line without a usable record; blank lines are left out),
    ``ue``, ``tot_bytes`` and ``ts`` (text).
    """
    line = F.trim(text)
    line = F.trim(F.regexp_replace(line, r",$", ""))
    line = F.regexp_replace(line, r"""^b(['"])(.*)\1$""", "$2")
    body = F.regexp_extract(line, r"(?s)(\{.*\})", 1)
    record = F.from_json(body, "map<string,string>", {"allowSingleQuotes": "true"})
    pairs = F.transform(F.map_entries(record), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["key"] == e["key"]))
    low = F.map_from_entries(last)
    keep = [c for c in lines.columns if c != text]
    out = lines.where(F.trim(text) != "").select(*keep, low.alias("_m"))

    def pick(*names: str) -> Column:
        return F.coalesce(*[F.try_element_at("_m", F.lit(n)) for n in names])

    dl, ul = pick("dlbytes", "dl_bytes").try_cast("double"), pick("ulbytes", "ul_bytes").try_cast("double")
    return out.select(
        *keep,
        (dl + ul).isNull().cast("int").alias("parse_error"),
        F.coalesce(pick("ue_id", "ueid", "ue"), F.lit("unknown")).alias("ue"),
        (dl + ul).alias("tot_bytes"),
        pick("timestamp", "ts").alias("ts"),
    )


# ---- tables of later stages --------------------------------------------------------------

LABEL_NAMES = ("label", "y_true", "y")  # fixed values
PREDICTION_NAMES = ("pred", "y_pred", "prediction")  # fixed values


def unify_predictions(df: DataFrame) -> DataFrame:
    """Rename the label and prediction columns of a prediction table to y_true and y_pred."""
    low = {c.lower(): c for c in df.columns}

    def find(names: tuple[str, ...], what: str) -> str:
        for c in df.columns:
            if c.lower() in names:
                return c
        raise ValueError(f"no {what} column among {sorted(low)}")

    return df.withColumnsRenamed({find(LABEL_NAMES, "label"): "y_true", find(PREDICTION_NAMES, "prediction"): "y_pred"})


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Concatenate tables whose columns differ; absent columns become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_metrics(parts: dict[str, DataFrame]) -> DataFrame:
    """Stack the metric tables of several models; ``model`` is added where it is absent."""
    named = [df if "model" in df.columns else df.withColumn("model", F.lit(m)) for m, df in parts.items()]
    return union_all(named)


def path_inventory(files: DataFrame, extensions: dict[str, tuple[str, ...]]) -> DataFrame:
    """Files of each layer by extension: hidden files left out, duplicates removed.

    ``files`` has family, layer and path; ``extensions`` maps a layer to its endings.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    wanted = F.lit(False)
    for layer, ends in extensions.items():
        wanted = wanted | ((F.col("layer") == layer) & ending.isin(*ends))
    return files.where(~name.startswith(".") & wanted).select("family", "layer", "path").distinct()


def list_files(spark: SparkSession, root: str, layer: str, family: str) -> DataFrame:
    """File listing below a folder, through Spark's own file source."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(F.lit(family).alias("family"), F.lit(layer).alias("layer"), F.col("path"))


def discover(df: DataFrame, columns: list[str]) -> DataFrame:
    """Which partition values exist, e.g. window settings or splits."""
    return df.select(*columns).distinct()


def read_run_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Nested run descriptions, one JSON document per file."""
    return spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
