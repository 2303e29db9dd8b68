"""Pair recordings of two layers by family and canonical name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crosswin.functions.expr import canon_stem
from crosswin.operators.scale import SALTS

STATUSES = ("paired", "ambiguous", "network_only", "radio_only")
TCP = "tcp_"
GROUP = ["family", "canon_stem"]


def stem_keys(paths: DataFrame) -> DataFrame:
    """Add ``canon_stem`` from the file name without its ending."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    return paths.select("family", "layer", "path", canon_stem(name).alias("canon_stem"))


def alias_keys(stems: DataFrame, mode: str = "conditional") -> DataFrame:
    """Resolve ``tcp_X`` names of the radio layer; adds ``aliased`` (0/1).

    ``off`` keeps them; ``always`` emits both names; ``conditional`` renames to X when the
    network layer has X and lacks ``tcp_X``.
    """
    if mode not in ("off", "conditional", "always"):
        raise ValueError("mode is one of off, conditional, always")
    plain = stems.withColumn("aliased", F.lit(0))
    if mode == "off":
        return plain
    has_prefix = (F.col("layer") == "radio") & F.col("canon_stem").startswith(TCP)
    short = F.substring("canon_stem", len(TCP) + 1, 1 << 20)
    if mode == "always":
        both = F.when(has_prefix, F.array(F.col("canon_stem"), short)).otherwise(F.array("canon_stem"))
        counted = stems.withColumn("aliased", has_prefix.cast("int"))
        # the alias is counted once per file, on the renamed copy
        return counted.withColumn("_k", F.explode(both)).select(
            "family", "layer", "path", F.col("_k").alias("canon_stem"),
            (F.col("aliased") * (F.col("_k") != F.col("canon_stem")).cast("int")).alias("aliased"))
    # only the few prefixed radio files meet the network key set
    network = stems.where("layer = 'network'").select("family", "canon_stem").distinct()
    candidates = stems.where(has_prefix).withColumn("_short", short)
    own = network.withColumn("_own", F.lit(1))
    other = network.select("family", F.col("canon_stem").alias("_short"), F.lit(1).alias("_other"))
    resolved = candidates.join(own, GROUP, "left").join(other, ["family", "_short"], "left")
    rename = F.col("_own").isNull() & F.col("_other").isNotNull()
    renamed = resolved.select(
        "family", "layer", "path",
        F.when(rename, F.col("_short")).otherwise(F.col("canon_stem")).alias("canon_stem"),
        rename.cast("int").alias("aliased"),
    )
    return plain.where(~has_prefix).unionByName(renamed)


def pair_counts(keyed: DataFrame) -> DataFrame:
    """Distinct files per side of every (family, name) group, with its status.

    The two sides meet in one aggregate, which gives the full outer join without a join.
    """
    sides = keyed.select(*GROUP, "layer", "path").distinct()
    counts = sides.groupBy(*GROUP).agg(
        F.count(F.when(F.col("layer") == "network", 1)).alias("n_pcaps"),
        F.count(F.when(F.col("layer") == "radio", 1)).alias("n_txts"),
    )
    return counts.withColumn("status", pair_status())


def pair_status():
    p, t = F.col("n_pcaps"), F.col("n_txts")
    return (
        F.when((p == 1) & (t == 1), "paired")
        .when((p > 0) & (t > 0), "ambiguous")
        .when(p > 0, "network_only")
        .otherwise("radio_only")
    )


def pair_groups(keyed: DataFrame) -> DataFrame:
    """Collapsed groups: counts, status, note and the sorted path lists.

    The path lists are the result itself; partial lists are merged map-side.
    """
    def files(layer: str):
        return F.array_sort(F.array_distinct(F.collect_set(F.when(F.col("layer") == layer, F.col("path")))))

    g = keyed.groupBy(*GROUP).agg(files("network").alias("pcap_paths"), files("radio").alias("txt_paths"))
    g = g.withColumns({"n_pcaps": F.size("pcap_paths"), "n_txts": F.size("txt_paths")})
    note = F.concat(
        F.when(F.col("n_pcaps") > 1, F.concat(F.lit("multiple_pcaps="), F.col("n_pcaps"), F.lit(";"))).otherwise(""),
        F.when(F.col("n_txts") > 1, F.concat(F.lit("multiple_txts="), F.col("n_txts"), F.lit(";"))).otherwise(""),
    )
    return g.withColumn("status", pair_status()).select(
        *GROUP, "status", "n_pcaps", "n_txts", "pcap_paths", "txt_paths", note.alias("note"))


def collapsed_export(groups: DataFrame) -> DataFrame:
    """Path lists as text joined by ``|``, for CSV."""
    return groups.withColumns({c: F.concat_ws("|", c) for c in ("pcap_paths", "txt_paths")})


def expand_pairs(keyed: DataFrame) -> DataFrame:
    """Candidate (pcap, txt) rows of every group; one-sided files keep an empty other side.

    This report lists each candidate of an ambiguous group, so its size is that of the
    result. Rows come from an equi-join of the two file lists on the group, the radio side
    copied to sub-groups over which the network side is spread.
    """
    sides = keyed.select(*GROUP, "layer", "path").distinct()
    counts = pair_counts(keyed)
    pcaps = sides.where("layer = 'network'").select(*GROUP, F.col("path").alias("pcap"))
    pcaps = pcaps.withColumn("_s", F.pmod(F.xxhash64("pcap"), F.lit(SALTS)).cast("int"))
    txts = sides.where("layer = 'radio'").select(*GROUP, F.col("path").alias("txt"))
    both = pcaps.join(
        txts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*GROUP, "_s"]).drop("_s")
    one_sided = counts.where("status in ('network_only', 'radio_only')").select(*GROUP)
    lonely = sides.join(one_sided, GROUP, "left_semi").select(
        *GROUP,
        F.when(F.col("layer") == "network", F.col("path")).otherwise("").alias("pcap"),
        F.when(F.col("layer") == "radio", F.col("path")).otherwise("").alias("txt"))
    return both.unionByName(lonely).join(
        counts.select(
            *GROUP, "status", F.col("n_pcaps").alias("n_pcaps_in_group"), F.col("n_txts").alias("n_txts_in_group")),
        GROUP)


def pair_summary(keyed: DataFrame) -> DataFrame:
    """Per family: files found, groups by status, aliases applied."""
    groups = pair_counts(keyed).groupBy("family").agg(
        *[F.count(F.when(F.col("status") == s, 1)).alias(f"{s}_groups") for s in STATUSES])
    files = keyed.groupBy("family").agg(
        F.count_distinct(F.when(F.col("layer") == "network", F.col("path"))).alias("pcaps_found"),
        F.count_distinct(F.when(F.col("layer") == "radio", F.col("path"))).alias("txts_found"),
        F.sum("aliased").alias("tcp_alias_applied"))
    return files.join(groups, "family")


def paired_manifest(keyed: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Manifest of the paired groups straight from the files: a paired group has one file per
    side, so the smallest path of each side is that file and no list is built."""
    df = keyed if not families else keyed.where(F.col("family").isin(*[f.strip() for f in families if f.strip()]))
    pairs = pair_counts(df).where("status = 'paired'").select(*GROUP)

    def only(layer: str):
        return F.min(F.when(F.col("layer") == layer, F.col("path")))

    files = df.groupBy(*GROUP).agg(only("network").alias("pcap_path"), only("radio").alias("txt_path"))
    return files.join(pairs, GROUP, "left_semi")


def extract_paired(collapsed: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Paired groups as a manifest; works on list columns and on ``|``-joined text."""
    df = collapsed.where("status = 'paired'")
    if families:
        df = df.where(F.col("family").isin(*[f.strip() for f in families if f.strip()]))

    def first(c: str):
        is_list = dict(df.dtypes)[c].startswith("array")
        return (F.col(c) if is_list else F.split(c, r"\|"))[0]

    return df.select(*GROUP, first("pcap_paths").alias("pcap_path"), first("txt_paths").alias("txt_path"))


def family_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows per family (and per further columns)."""
    return df.groupBy(*(by or []), "family").agg(F.count("*").alias("n"))
