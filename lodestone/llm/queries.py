"""The registered queries of this subpackage: each applies its operator to its whole table, with production settings."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, matroska, quality, secrets, sharding, sitestyle, tokenfile, toxicity
from .common import one_in, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), one_in("doc_id", 5, 0)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.classify(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), one_in("doc_id", 4, 2)
    network = quality.train(docs, table(spark, sf_dir, "labels"), ~held)
    return quality.classify(docs, network).select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 16, seed=2026)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row", "position")


def op6_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = tokenfile.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sitestyle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitestyle.main_text(table(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_toxicity, op3_matroska, op4_quality, op5_shards, op6_tokenfiles, op7_jaccard, op8_decontaminate, op9_sitestyle, op10_secrets)}

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+')"
_RUNS = "case when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) end"

ORACLE_SQL = {
    "op7_jaccard": f"""
        with recursive w as (select doc_id, {_WORDS} as ws from documents where doc_id is not null),
        s as (select distinct doc_id, unnest({_RUNS}) as g from w),
        n as (select doc_id, count(*) as c from s group by doc_id),
        l as (select a.doc_id as a, b.doc_id as b, count(*) as i from s as a join s as b on a.g = b.g and a.doc_id <> b.doc_id group by all),
        k as (select l.a, l.b, l.i = x.c and l.i = y.c as same from l join n as x on x.doc_id = l.a join n as y on y.doc_id = l.b where l.i >= 0.8 * (x.c + y.c - l.i) - 1e-9),
        r as (select doc_id as id, doc_id as o from n union select r.id, k.b from r join k on k.a = r.o),
        p as (select id, min(o) as class_id from r group by id),
        q as (select a, count(*) as links, count(*) filter (same) as copies from k group by a)
        select p.id as doc_id, p.class_id, coalesce(q.links, 0) as n_links, coalesce(q.copies, 0) + 1 as n_copies from p left join q on q.a = p.id""",
    "op8_decontaminate": f"""
        with w as (select 0 as k, doc_id as id, {_WORDS} as ws from documents union all select 1, item_id, {_WORDS} from benchmark),
        s as (select distinct k, id, unnest({_RUNS}) as g from w where len(ws) > 0),
        q as (select id, count(*) as n from s where k = 1 group by id),
        f as (select a.id as doc_id, b.id as item_id, count(*) as n_shared, any_value(q.n) as n_item from s as a join s as b on a.g = b.g and a.k = 0 and b.k = 1 join q on q.id = b.id group by all)
        select doc_id, item_id, n_shared, n_item, n_shared / n_item as containment from f where n_shared >= 0.8 * n_item - 1e-9""",
}
