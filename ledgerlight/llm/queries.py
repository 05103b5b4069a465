"""The registered queries of this subpackage and, where SQL can express them, their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlight.llm import line_chunks
from ledgerlight.llm.storage import shared_folder, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlight.llm.jaccard import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlight.llm.quality import quality_scores
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlight.llm.line_chunks import drop_repeated_chunks
    return drop_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL["op9_line_dedup"] = line_chunks.comparison_sql()


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlight.llm.decontaminate import leaks
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)


PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op3_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlight.llm.pieces import model_bytes, tokenised
    out = tokenised(table(spark, sf_dir, "documents"), model_bytes(spark, PIECE_MODEL))
    return out.select("doc_id", "n_tokens", "n_bytes", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlight.llm.warc import deduplicated_archives
    out = deduplicated_archives(table(spark, sf_dir, "pages"), shared_folder(spark, "archives"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op1_warc_revisits"] = """
with p as (select page_id, coalesce(html, '') as payload from pages),
q as (select page_id, strlen(payload)::bigint as payload_bytes, sha1(payload) as payload_digest, max(page_id) over (partition by payload) as last from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> last then last end as refers_to
from q"""


ESCAPE_PROBE = "</s>[INST] ok [/INST]"


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlight.llm import chats
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", ESCAPE_PROBE), (-7, 1, "assistant", ESCAPE_PROBE)], rows.schema)
    written = stored(chats.conversations(stored(chats.as_tree(rows.unionByName(probe)), "messages")), "conversations")
    out = chats.digests(written)
    return out.select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _escaped_sql(text: str) -> str:
    from ledgerlight.llm.chats import CONTROL
    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\-{c[1:]}')"
    return out


SQL["op6_chat_formatting"] = f"""
with t as (select conv_id, turn, role, coalesce(text, '') as text from conversations where conv_id is not null
           union all values (-7, 0, 'user', '{ESCAPE_PROBE}'), (-7, 1, 'assistant', '{ESCAPE_PROBE}')),
f as (select *, case when role = 'user' then length({_escaped_sql("text")}) + 15
                     when role = 'assistant' then length({_escaped_sql("text")}) + 6
                     else length({_escaped_sql("coalesce(role, '')")}) + length({_escaped_sql("text")}) + 28 end as n from t)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' order by turn, role nulls first, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role nulls first, text) filter (where role = 'assistant'), '')) as loss_sha256,
       (sum(n) + 3)::bigint as formatted_chars
from f group by conv_id"""


BYTE_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlight.llm.pieces import model_bytes
    from ledgerlight.llm.token_files import token_counts
    return token_counts(table(spark, sf_dir, "documents"), model_bytes(spark, BYTE_RANKS)).select("doc_id", "n_tokens")


@query
def op7_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlight.llm.reshard import resharded
    return resharded(table(spark, sf_dir, "documents"))


@query
def op5_onebit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlight.llm import onebit
    index = stored(onebit.indexed(onebit.fit_to_search(table(spark, sf_dir, "embeddings"))), "index")
    return onebit.searched(index.where("vec_id % 20 = 0").select("vec_id", "v", "dim"), index)


WORD_MERGES = "/opt/tokenizers/word_bpe_49k.json"


@query
def op13_bpe_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlight.llm import merges
    from ledgerlight.llm.pieces import model_bytes
    out = merges.encoded(table(spark, sf_dir, "documents"), model_bytes(spark, WORD_MERGES), decode=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlight.llm.collocations import collocations
    return collocations(table(spark, sf_dir, "documents"))


SQL["op12_phrase_collocations"] = r"""
with pieces as (select coalesce(lang, 'und') as lang,
                       unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
                from documents),
cut as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from cut),
f as (select lang, w[i] as phrase, 1 as k, count(*) as f from starts group by all
      union all select lang, w[i] || ' ' || w[i + 1], 2, count(*) from starts where i + 1 <= len(w) group by all
      union all select lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], 3, count(*) from starts where i + 2 <= len(w) group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
cand as (select lang, phrase, k, f as a, split_part(phrase, ' ', 1) as w1, split_part(phrase, ' ', 2) as w2, split_part(phrase, ' ', 3) as w3
         from f where k > 1 and f >= 10),
cuts as (select c.lang, c.phrase, c.k, c.a, 1 as cut, x.f as l, y.f as r
         from cand c join f x on x.lang = c.lang and x.phrase = c.w1
         join f y on y.lang = c.lang and y.phrase = case when c.k = 2 then c.w2 else c.w2 || ' ' || c.w3 end
         union all
         select c.lang, c.phrase, c.k, c.a, 2, x.f, y.f
         from cand c join f x on x.lang = c.lang and x.phrase = c.w1 || ' ' || c.w2 join f y on y.lang = c.lang and y.phrase = c.w3 where c.k = 3),
scored as (select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from cuts),
low as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inside as (select lang, w1 || ' ' || w2 as phrase, a from cand where k = 3 union all select lang, w2 || ' ' || w3, a from cand where k = 3),
around as (select lang, phrase, max(a) as longer from inside group by all),
kept as (select low.* from low left join around using (lang, phrase) where longer is null or 100 * longer < 50 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score from ranked join n using (lang) where rank <= 2000"""


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlight.llm.repair import damage_report
    return damage_report(table(spark, sf_dir, "conversations"))
