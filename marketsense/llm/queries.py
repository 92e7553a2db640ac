"""Registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketsense.llm import alignment, fingerprints, language, maxscore, mixing, packing, periodic, projection_forest, quality, simhash, suffix_tree, toxicity, warc
from marketsense.llm.common import WORD
from marketsense.session import join_path, shared_folder, stage

TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), maxscore.quantised(F.col("embedding")).alias("vector"))
    return maxscore.top_k(vectors, vectors.filter(F.col("id") % 50 == 0), 5)


def op3_restored_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_pack_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER, RANKS)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_parse_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_chain(_table(spark, sf_dir, "documents"))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op7_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(_table(spark, sf_dir, "documents"))


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.plan_captures(_table(spark, sf_dir, "pages"))
    path = join_path(shared_folder(spark), "marketsense", f"warc-{uuid.uuid4().hex}")
    warc.write_archives(captures, path)
    nested = warc.assemble(warc.read_archives(spark, path), payloads=False)
    page_id = F.regexp_extract(F.decode(F.get("metadata", F.lit(0))["block"], "utf-8"), r"pageId: (-?\d+)", 1)
    rows = nested.select(
        "capture", F.nullif(page_id, F.lit("")).cast("long").alias("page_id"), F.col("response.payload_length").alias("payload_bytes"),
        F.regexp_replace("response.digest", "^sha256:", "").alias("payload_digest"), F.col("response.type").alias("record_type"),
        F.coalesce("response.refers_to", "capture").alias("holder"),
    )
    # A small row per capture, written once: the archives are read in one pass.
    rows = stage(rows, "warc-rows")
    # What a revisit stands for is what its response held when it was read.
    holders = rows.filter(F.col("record_type") == "response").select(F.col("capture").alias("holder"), F.col("page_id").alias("held_by"), F.col("payload_bytes").alias("held_bytes"), F.col("payload_digest").alias("held_digest"))
    read = rows.join(holders, "holder", "left")
    refers_to = F.when(F.col("record_type") == "revisit", F.col("held_by")).alias("refers_to")
    return read.select("page_id", F.coalesce("held_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("held_digest", "payload_digest").alias("payload_digest"), "record_type", refers_to)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op10_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def _periodic_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by the id's crc32, the words from one on repeat a block of them."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    chosen = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).alias("g"))
    words = chosen.withColumn("words", F.when(F.col("chosen"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), F.lit(0))))
    placed = words.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rest = F.col("n") - F.col("a")
    placed = placed.withColumn("p", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int"))
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return placed.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(_periodic_texts(_table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda run: F.struct(run["length"].alias("length"), (-run["start"]).alias("start"), (-run["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda run: F.concat(run["start"].cast("string"), F.lit(","), run["length"].cast("string"), F.lit(","), run["period"].cast("string"), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return best.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return projection_forest.nearest(vectors, vectors.filter(F.col("id") % 20 == 0), 20)


def op13_aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(groups):
        return F.when(groups == "", "").otherwise(F.sha2(groups.cast("binary"), 256))

    aligned = alignment.align_documents(_table(spark, sf_dir, "documents"), TOKENIZER, PIECES, RANKS, digest)
    return aligned.withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_maxscore_search": op2_maxscore_search,
    "op3_restored_toxicity": op3_restored_toxicity,
    "op4_pack_curve": op4_pack_curve,
    "op5_parse_fingerprints": op5_parse_fingerprints,
    "op6_simhash_components": op6_simhash_components,
    "op7_suffix_tree_scores": op7_suffix_tree_scores,
    "op8_warc_transactions": op8_warc_transactions,
    "op9_language_id": op9_language_id,
    "op10_boosted_quality": op10_boosted_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_forest_neighbours": op12_forest_neighbours,
    "op13_aligned_tokens": op13_aligned_tokens,
}

ORACLES = {
    "op1_mix_sources": r"""
        with sized as (
            select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
                   cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '-' || text, '')), 1, 15) as bigint) as key
            from documents),
        sources as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
        ranked as (
            select *, row_number() over (order by source nulls last) - 1 as ordinal from sources),
        weighed as (
            select *, case ordinal % 3 when 0 then 3 when 1 then 1 else 2 end as weight, cast(2 as double) * source_size as cap from ranked),
        filling as (
            select *, (cast(1.5 as double) * sum(source_size) over () - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
            from weighed window w as (order by cap / weight, ordinal rows between unbounded preceding and 1 preceding)),
        flagged as (select *, cap / weight <= level as is_full from filling),
        targets as (
            select source, source_size, case when is_full then cap else weight * ((cast(1.5 as double) * sum(source_size) over () - sum(case when is_full then cap else 0 end) over ())
                   / sum(case when is_full then 0 else weight end) over ()) end as target
            from flagged),
        placed as (
            select s.doc_id, s.size, t.source_size, t.target,
                   coalesce(sum(s.size) over (partition by s.source order by s.key, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as start,
                   cast(floor(t.target) as bigint) as budget
            from sized s join targets t on s.source is not distinct from t.source)
        select doc_id, size, source_size, target,
               cast(case when source_size = 0 then 0 else (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) end as bigint) as taken
        from placed""",
    "op2_maxscore_search": """
        with v as (
            select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as vector from embeddings
            where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (
            select q.row, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.vector, c.vector) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
        ranked as (select *, row_number() over (partition by row order by score desc, vec_id) as rank from scored)
        select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5""",
    "op8_warc_transactions": r"""
        with p as (select page_id, coalesce(html, '') as html from pages),
        d as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha256(html) as payload_digest from p),
        m as (select *, min(page_id) over (partition by payload_digest, payload_bytes) as leader from d)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 100 and leader <> page_id then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and leader <> page_id then leader end as refers_to
        from m""",
}
