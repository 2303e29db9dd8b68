"""Pairing of file inventories."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from crosswin.functions.expr import canon_stem
from crosswin.operators import pairing
from crosswin.operators.scale import shared_folder
from crosswin.plans import bindings as b
from crosswin.plans.registry import query, rounded
from crosswin.sources import readers

ENDINGS = {"network": ("pcap", "pcapng"), "radio": ("txt",)}


def keyed(spark, d, mode="conditional"):
    files = readers.path_inventory(b.paths(spark, d), ENDINGS)
    return pairing.alias_keys(pairing.stem_keys(files), mode)


KEY_SQL = b.PATHS_SQL + """,
net_keys AS (SELECT DISTINCT family, k FROM stems WHERE layer = 'network'),
keyed AS (
  SELECT s.family, s.layer, s.path,
         CASE WHEN ren THEN substr(s.k, 5) ELSE s.k END AS k, CAST(ren AS BIGINT) AS aliased
  FROM (SELECT s.*, s.layer = 'radio' AND s.k LIKE 'tcp\\_%' ESCAPE '\\'
               AND (family, s.k) NOT IN (SELECT family, k FROM net_keys)
               AND (family, substr(s.k, 5)) IN (SELECT family, k FROM net_keys) AS ren FROM stems s) s),
grp AS (
  SELECT family, k AS canon_stem, count(DISTINCT CASE WHEN layer = 'network' THEN path END) AS n_pcaps,
         count(DISTINCT CASE WHEN layer = 'radio' THEN path END) AS n_txts,
         string_agg(DISTINCT CASE WHEN layer = 'network' THEN path END, '|' ORDER BY CASE WHEN layer = 'network' THEN path END) AS pcap_paths,
         string_agg(DISTINCT CASE WHEN layer = 'radio' THEN path END, '|' ORDER BY CASE WHEN layer = 'radio' THEN path END) AS txt_paths
  FROM keyed GROUP BY 1, 2),
grps AS (
  SELECT *, CASE WHEN n_pcaps = 1 AND n_txts = 1 THEN 'paired' WHEN n_pcaps > 0 AND n_txts > 0 THEN 'ambiguous'
                 WHEN n_pcaps > 0 THEN 'network_only' ELSE 'radio_only' END AS status FROM grp)"""


@query("canon_stem", "P1", f"WITH {b.PATHS_SQL} SELECT path, k AS canon_stem FROM stems")
def _canon_stem(spark, d):
    return pairing.stem_keys(b.paths(spark, d)).select("path", "canon_stem")


@query("canon_text", "P1", """SELECT p_partkey, replace(trim(regexp_replace(replace(lower('--' || p_brand || ' -_' || p_name || '_'), '-', '_'), '__+', '_', 'g'), '_'), 'npig', 'nping') AS stem FROM part""")
def _canon_text(spark, d):
    text = F.concat(F.lit("--"), "p_brand", F.lit(" -_"), "p_name", F.lit("_"))
    return b.table(spark, d, "part").select("p_partkey", canon_stem(text).alias("stem"))


@query("path_inventory", "S12", f"WITH {b.PATHS_SQL} SELECT DISTINCT family, layer, path FROM paths")
def _path_inventory(spark, d):
    twice = b.paths(spark, d)
    hidden = twice.withColumn("path", F.regexp_replace("path", "/([^/]+)$", "/.$1"))
    other = twice.withColumn("path", F.concat("path", F.lit(".bak")))
    return readers.path_inventory(twice.unionByName(twice).unionByName(hidden).unionByName(other), ENDINGS)


@query("pair_groups", "J1 P9", f"""WITH {KEY_SQL}
SELECT family, canon_stem, status, n_pcaps, n_txts, coalesce(pcap_paths, '') AS pcap_paths, coalesce(txt_paths, '') AS txt_paths,
       CASE WHEN n_pcaps > 1 THEN 'multiple_pcaps=' || n_pcaps || ';' ELSE '' END || CASE WHEN n_txts > 1 THEN 'multiple_txts=' || n_txts || ';' ELSE '' END AS note
FROM grps""")
def _pair_groups(spark, d):
    return rounded(pairing.collapsed_export(pairing.pair_groups(keyed(spark, d))))


@query("pair_status", "P9", f"WITH {KEY_SQL} SELECT family, canon_stem, n_pcaps, n_txts, status FROM grps")
def _pair_status(spark, d):
    return pairing.pair_counts(keyed(spark, d))


@query("tcp_alias", "J2", f"WITH {KEY_SQL} SELECT family, layer, path, k AS canon_stem, aliased FROM keyed")
def _tcp_alias(spark, d):
    return rounded(keyed(spark, d))


@query("tcp_alias_always", "J2", f"""WITH {b.PATHS_SQL}
SELECT family, layer, path, k AS canon_stem, 0::BIGINT AS aliased FROM stems
UNION ALL SELECT family, layer, path, substr(k, 5), 1 FROM stems WHERE layer = 'radio' AND k LIKE 'tcp\\_%' ESCAPE '\\'""")
def _tcp_alias_always(spark, d):
    return rounded(keyed(spark, d, "always"))


@query("expand_pairs", "J3", f"""WITH {KEY_SQL},
p AS (SELECT DISTINCT family, k AS canon_stem, path AS pcap FROM keyed WHERE layer = 'network'),
t AS (SELECT DISTINCT family, k AS canon_stem, path AS txt FROM keyed WHERE layer = 'radio')
SELECT g.family, g.canon_stem, status, coalesce(pcap, '') AS pcap, coalesce(txt, '') AS txt,
       n_pcaps AS n_pcaps_in_group, n_txts AS n_txts_in_group
FROM grps g LEFT JOIN p USING (family, canon_stem) LEFT JOIN t USING (family, canon_stem)""")
def _expand_pairs(spark, d):
    return pairing.expand_pairs(keyed(spark, d))


@query("pair_summary", "A15", f"""WITH {KEY_SQL}
SELECT family, count(CASE WHEN status = 'paired' THEN 1 END) AS paired_groups, count(CASE WHEN status = 'ambiguous' THEN 1 END) AS ambiguous_groups,
       count(CASE WHEN status = 'network_only' THEN 1 END) AS network_only_groups, count(CASE WHEN status = 'radio_only' THEN 1 END) AS radio_only_groups,
       any_value(pcaps_found) AS pcaps_found, any_value(txts_found) AS txts_found, any_value(tcp_alias_applied) AS tcp_alias_applied
FROM grps JOIN (
  SELECT family, count(DISTINCT CASE WHEN layer = 'network' THEN path END) AS pcaps_found,
         count(DISTINCT CASE WHEN layer = 'radio' THEN path END) AS txts_found, CAST(sum(aliased) AS BIGINT) AS tcp_alias_applied
  FROM keyed GROUP BY 1) USING (family) GROUP BY family""")
def _pair_summary(spark, d):
    return pairing.pair_summary(keyed(spark, d))


@query("extract_paired", "P12", f"""WITH {KEY_SQL}
SELECT family, canon_stem, pcap_paths AS pcap_path, txt_paths AS txt_path FROM grps
WHERE status = 'paired' AND family IN ('ECONOMY', 'SMALL', 'STANDARD')""")
def _extract_paired(spark, d):
    groups = pairing.collapsed_export(pairing.pair_groups(keyed(spark, d)))
    return pairing.extract_paired(groups, ["ECONOMY", " SMALL ", "STANDARD"])


@query("manifest_first_row", "S2 T5", f"""WITH {KEY_SQL},
m AS (SELECT *, row_number() OVER (PARTITION BY canon_stem ORDER BY length(family), family) AS rn FROM grps WHERE status = 'paired')
SELECT canon_stem AS run_id, family, pcap_paths AS pcap_path, txt_paths AS txt_path FROM m WHERE rn = 1""")
def _manifest_first_row(spark, d):
    rows = pairing.paired_manifest(keyed(spark, d))
    return readers.manifest(rows.withColumn("ord", F.struct(F.length("family").alias("n"), F.col("family").alias("f"))))


@query("manifest_file", "S2 T5", f"""WITH {KEY_SQL},
m AS (SELECT *, row_number() OVER (PARTITION BY canon_stem ORDER BY family) AS rn FROM grps WHERE status = 'paired')
SELECT canon_stem AS run_id, family, pcap_paths AS pcap_path, txt_paths AS txt_path FROM m WHERE rn = 1""")
def _manifest_file(spark, d):
    """The manifest as one sorted CSV file, read back in its line order."""
    path = os.path.join(shared_folder(spark), f"manifest-{uuid.uuid4().hex}.csv")
    rows = pairing.paired_manifest(keyed(spark, d)).select("family", "canon_stem", "pcap_path", "txt_path")
    rows.coalesce(1).sortWithinPartitions("canon_stem", "family").write.option("header", True).csv(path)
    return readers.read_manifest(spark, path)


@query("listed_files", "S12", f"""WITH {KEY_SQL}
SELECT 'stages' AS family, 'processed' AS layer, family AS folder FROM grps WHERE status = 'paired' GROUP BY family""")
def _listed_files(spark, d):
    """Folders of a written stage, from the listing of its files."""
    path = os.path.join(shared_folder(spark), f"stage-{uuid.uuid4().hex}")
    pairing.paired_manifest(keyed(spark, d)).write.partitionBy("family").parquet(path)
    files = readers.path_inventory(readers.list_files(spark, path, "processed", "stages"), {"processed": ("parquet",)})
    return files.select("family", "layer", F.regexp_extract("path", "family=([^/]+)/", 1).alias("folder")).distinct()


@query("family_counts", "A16", f"WITH {KEY_SQL} SELECT family, count(*) AS n FROM grps WHERE status = 'paired' GROUP BY 1")
def _family_counts(spark, d):
    return pairing.family_counts(pairing.paired_manifest(keyed(spark, d)))
