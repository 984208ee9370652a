"""Registered queries of the subpackage: one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate components over all documents (3-word shingles, 3 bits)."""
    from docweave.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


@register("op5_mix_pareto")
def op5_mix_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 1, 2, 3 repeating, at most 3 times a source's size."""
    from docweave.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "expected")


@register("op7_repetition")
def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base quality measures and repetition coverage of all documents."""
    from docweave.llm.repetition import repetition_rules

    return repetition_rules(table(spark, sf_dir, "documents"))


@register("op1_chat_format")
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back from the written output."""
    from docweave.llm.chat_format import format_conversations, read_back
    from docweave.llm.storage import staged

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return read_back(staged(format_conversations(turns.unionByName(probe)), "chat"))


def new_folder(spark: SparkSession, name: str) -> str:
    import uuid

    from docweave.session import scratch_path

    return scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")


@register("op2_token_store")
def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in Re-Pair shards, read back from the files."""
    import public_tokenizers

    from docweave.llm.token_store import token_output

    return token_output(table(spark, sf_dir, "documents"), new_folder(spark, "shards"), public_tokenizers.path("word_bpe_49k.json"))


@register("op3_html_density")
def op3_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages by composite text density."""
    from docweave.llm.html_density import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; learned from the labels of documents that are not held out."""
    from docweave.llm.toxicity import held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@register("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, whole or edited, with the aligned words."""
    from docweave.llm.decontaminate import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op4_edit_token_counts")
def op4_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after a clean-up, by re-encoding only what its edits touch."""
    import public_tokenizers

    from docweave.llm.token_counts import edited_token_counts

    return edited_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@register("op8_line_spread", oracle="""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
l as (select rid, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d),
k as (select *, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) as key from l),
b as (select key from k where key <> '' group by key having count(distinct source) >= 10),
r as (select k.rid, count(*) as n_lines, count(b.key) as n_removed,
             coalesce(string_agg(case when b.key is null then line end, chr(10) order by pos) filter (where b.key is null), '') as text
      from k left join b on k.key = b.key group by k.rid)
select d.doc_id, r.n_lines, r.n_removed, length(r.text) as n_chars, md5(r.text) as text_md5 from d join r on d.rid = r.rid
""")
def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that occur on ten or more sources."""
    from pyspark.sql import functions as F

    from docweave.llm.line_spread import remove_boilerplate

    out = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), min_sites=10)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("op13_fill_in_middle", oracle="""
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
g as (select doc_id, t, cast(length(t) as bigint) as n, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
             cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
             case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
                  when h4 % 100 < 20 then 'spm' else 'psm' end as form from g),
s as (select *, substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as e from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || e || '<M>' || m else '<S>' || e || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from s
""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in fill-in-middle form, and restored from it."""
    from pyspark.sql import functions as F

    from docweave.llm.fill_in_middle import fim_restore, fim_transform

    out = fim_restore(fim_transform(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2("restored", 256).alias("restored_sha256"))


@register("op12_threshold_topk", oracle="""
with r as (select row_number() over () as rid, vec_id, embedding from embeddings),
v as (select rid, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from r
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.rid as qr, q.vec_id as query_id, c.vec_id, c.rid, cast(list_dot_product(q.e, c.e) as bigint) as score
      from v q join v c on q.rid <> c.rid where q.vec_id % 50 = 0),
t as (select *, row_number() over (partition by qr order by score desc, vec_id, rid) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from t where rank <= 5
""")
def op12_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 rows of greatest integer inner product for every vector whose id is divisible by 50, among all rows."""
    from pyspark.sql import functions as F

    from docweave.llm.threshold_topk import threshold_topk

    return threshold_topk(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


@register("op11_turn_repair")
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule, repaired at least cost: fault counts, audit and digest of the repaired turns."""
    from docweave.llm.storage import staged
    from docweave.llm.turn_repair import damaged, repair_audits

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_audits(staged(damaged(turns), "damaged"), turns)
