"""One query for each operator, over its whole table, and the oracles that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import collocations, fill_middle, license_scan, secret_scan, warc
from . import line_dedup as lines
from .bpe import encoded_digests
from .decontamination import contained_items
from .line_dedup import line_dedup
from .near_dedup import near_duplicates
from .quality_rules import judged
from .token_counts import token_counts
from .token_files import token_files
from .toxicity import toxicity
from .vocabularies import vocabulary
from .warc import archived


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"))


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(_table(spark, sf_dir, "pages"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_toxicity, op3_license_scan, op4_quality_rules, op5_line_dedup, op6_bpe_encode_decode, op7_benchmark_decontamination, op8_secret_scan, op9_warc_archive)
    + (op10_minhash_near_dedup, op11_token_files, op12_fill_in_middle, op13_collocations)
}

#: Five-word shingles of lower-cased texts as (id, shingle) rows for DuckDB; {id} and {table} name them.
_SHINGLES = r"""
    select distinct {id}, case when len(w) < 5 then w else w[i:i + 4] end as s
    from (select {id}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from (
        select {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from {table}
    ) where len(w) > 0)
"""
_DOC, _ITEM = _SHINGLES.format(id="doc_id", table="documents"), _SHINGLES.format(id="item_id", table="benchmark")

OP7_SQL = f"""
with d as materialized ({_DOC}), b as materialized ({_ITEM}),
     n as (select item_id, count(*) as n_item from b group by item_id),
     x as (select item_id, doc_id, count(*) as n_shared from b join d using (s) group by all)
select item_id, doc_id, n_item, n_shared, n_shared::double / n_item as containment
from x join n using (item_id) where 100 * n_shared >= 80 * n_item
"""

OP10_SQL = f"""
with recursive d as materialized ({_DOC}),
     n as materialized (select doc_id, count(*) as n from d group by doc_id),
     x as (select a.doc_id as a, b.doc_id as b, count(*) as m from d a join d b using (s) where a.doc_id <> b.doc_id group by all),
     e as materialized (select a, b from x join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * m >= 85 * (na.n + nb.n - m)),
     r as (select doc_id as a, doc_id as c from documents union select e.b as a, r.c from r join e on e.a = r.a),
     c as (select a as doc_id, min(c) as component_id from r group by a)
select doc_id, coalesce(n.n, 0) as n_shingles, component_id, doc_id = component_id as kept
from c left join n using (doc_id)
"""

ORACLES: dict[str, str] = {"op5_line_dedup": lines.ORACLE_SQL, "op7_benchmark_decontamination": OP7_SQL, "op9_warc_archive": warc.ORACLE_SQL, "op10_minhash_near_dedup": OP10_SQL}
ORACLES |= {"op12_fill_in_middle": fill_middle.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}
