"""Registered queries: each maps the given tables to an operator's interface and its result back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmart.llm import (
    decontaminate,
    hard_negatives,
    jaccard_join,
    language,
    language_model,
    line_dedup,
    mixing,
    neighbours,
    private_data,
    secret_scan,
    sharding,
    toxicity,
    turn_repair,
)
from clipmart.llm.common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as transcripts."""
    return as_transcripts(spark.read.parquet(f"{folder}/documents.parquet"))


def as_transcripts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("video_id"), F.col("text").alias("transcript"), F.col("lang").alias("language"),
        F.col("source").alias("source_key"),
    )


@query()
def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, folder))
    return mixed.select(
        F.col("video_id").alias("doc_id"), F.col("n_words").alias("size"), F.col("source_words").alias("source_size"),
        F.col("target_words").alias("target"), F.col("taken_words").alias("taken"), F.col("source_key").alias("source"), "mix_start",
    )


@query()
def op2_shard(spark: SparkSession, folder: str) -> DataFrame:
    dealt = sharding.shard_transcripts(documents(spark, folder))
    return dealt.select(
        F.col("video_id").alias("doc_id"), F.col("n_bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def toxic_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the documents that may be learned from."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(F.col("doc_id").alias("video_id"), "toxic")
    return labels.filter(~held_out("video_id", 4))


@query()
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    transcripts = documents(spark, folder)
    scored = toxicity.toxicity(transcripts, toxicity.train_toxicity(transcripts, toxic_labels(spark, folder)))
    return scored.select(
        F.col("video_id").alias("doc_id"), held_out("video_id", 4).alias("held_out"), "score",
        F.col("toxic").cast("int").alias("predicted"),
    )


@query()
def op4_language_model(spark: SparkSession, folder: str) -> DataFrame:
    transcripts = documents(spark, folder).withColumn("learn", ~held_out("video_id", 7))
    scored = language_model.score_transcripts(transcripts)
    return scored.select(
        F.col("video_id").alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query()
def op5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


@query()
def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select(
        F.col("video_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest(F.col("items")).alias("items_sha256"), "contaminated",
    )


@query()
def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.near_duplicates(documents(spark, folder))
    return found.select(F.col("video_id").alias("doc_id"), "n_shingles", "component_id")


@query()
def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    transcripts = documents(spark, folder)
    codes = language.train_languages(transcripts.filter(~held_out("video_id", 4)))
    told = language.identify_language(transcripts, codes)
    return told.select(
        F.col("video_id").alias("doc_id"), held_out("video_id", 4).alias("held_out"), F.col("language_pred").alias("lang_pred"),
        "score", "ambiguous",
    )


@query()
def op9_private_data(spark: SparkSession, folder: str) -> DataFrame:
    found = private_data.private_spans(documents(spark, folder))
    spans = F.col("spans")
    return found.select(
        F.col("video_id").alias("doc_id"),
        *[private_data.count_of(spans, k).alias(f"n_{k}") for k in private_data.KINDS[:4]],
        private_data.base_digest(spans).alias("base_sha256"), private_data.joined(spans).alias("spans"),
    )


@query()
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, folder), min_chars=1)
    return kept.select(
        F.col("video_id").alias("doc_id"), "n_lines", "n_dropped", F.length("transcript").cast("long").alias("kept_chars"),
        F.crc32("transcript").alias("kept_crc32"),
    )


#: CRC-32 of the text ``k`` in DuckDB, which has no such function: eight shifts for each byte.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295 :: bigint, list_transform(string_split(k, ''), lambda c: ord(c) :: bigint)), lambda crc, b:
  list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0] :: bigint[], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"""


def _repair_sql() -> str:
    """The cheapest edits by dynamic programming: for each pattern state the least (cost, initials) after each row."""
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    after = (2, 2, 3, 2)
    speaker = {2: "user:", 3: "assistant:"}
    far = "{'c': 1000000000, 'a': '', 'r': [] :: varchar[]}"

    def grown(way: str, cost: str, mark: str, line: str | None) -> str:
        kept = f"list_append({way}.r, {line})" if line else f"{way}.r"
        return f"{{'c': {way}.c + {cost}, 'a': {way}.a || '{mark}', 'r': {kept}}}"

    def least(ways: list[str]) -> str:
        return f"list_min([{', '.join(ways)}])"

    # Before a row, up to two insertions; two steps let each state be reached through another one.
    inserts = []
    for step in range(2):
        names = [f"{'sp'[step]}{q}" for q in range(4)]
        new = [
            least([names[q], *[grown(names[p], "3", "I", f"'{speaker[q]}'") for p in range(4) if after[p] == q]]) if q > 1 else names[q] for q in range(4)
        ]
        inserts.append(", ".join(f"{c} as {'pt'[step]}{q}" for q, c in enumerate(new)))
    keep = {1: [("s", 0)], 2: [("u", 0), ("u", 1), ("u", 3)], 3: [("a", 2)]}
    rows = []
    for q in range(4):
        ways = [grown(f"t{q}", "4", "D", None)]
        for initial, p in keep.get(q, []):
            ways.append(f"case when not gone and initial = '{initial}' then {grown(f't{p}', 'more', 'K', 'role || chr(58) || text')} else {far} end")
        for p in range(4):
            if after[p] == q:
                ways.append(f"case when not gone then {grown(f't{p}', '3 + more', 'R', f"'{speaker[q]}' || text")} else {far} end")
        rows.append(f"{least(ways)} as s{q}")
    states = ", ".join(f"s{q}" for q in range(4))
    return f"""with recursive raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
      coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
    coded as (select *, {_CRC_SQL} % 20 as code from raw),
    damaged as (select conv_id, turn, case when code = 4 then 'user' else role end as role, case code when 1 then '' when 2 then
      regexp_replace(text, '[.!?]', '', 'g') else text end as text from coded, range(case when code = 3 then 2 else 1 end) where code <> 0),
    placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, rtrim(text, {blanks}) as bare,
      left(role, 1) as initial from damaged),
    again as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again from placed),
    judged as (select *, bare = '' as blank, bare <> '' and again as dup, bare <> '' and not again and right(bare, 1) not in ('.', '!', '?') as cut,
      bare = '' or again as gone, lag(initial) over (partition by conv_id order by i) || initial as pair from again),
    j as (select *, case when cut then 3 else 0 end as more from judged),
    faults as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
      count(*) filter (dup) as duplicate, count(*) filter (cut) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal,
      count(*) as n from j group by 1),
    f as (select conv_id, 0 :: bigint as i, {{'c': 0, 'a': '', 'r': [] :: varchar[]}} as s0, {far} as s1, {far} as s2, {far} as s3 from faults
      union all select conv_id, i, {', '.join(rows)} from (select *, {inserts[1]} from (select f.conv_id, f.i + 1 as i, j.role, j.text, j.gone, j.more, j.initial,
        {inserts[0]} from f join j on j.conv_id is not distinct from f.conv_id and j.i = f.i + 1) x) y)
    select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
      coalesce(illegal, 0) as illegal, cast(coalesce(best.c, 0) as bigint) as cost, coalesce(best.a, '') as audit, sha256(coalesce(array_to_string(best.r, chr(10)), '')) as repaired_sha256
    from (select distinct conv_id from conversations) c left join faults on faults.conv_id is not distinct from c.conv_id
    left join (select f.conv_id, list_min([s0, s3, {grown('s2', '3', 'I', "'assistant:'")}, {{'c': s1.c + 6, 'a': s1.a || 'II', 'r': s1.r || ['user:', 'assistant:']}}]) as best
      from f join faults on f.conv_id is not distinct from faults.conv_id and f.i = faults.n) b on b.conv_id is not distinct from c.conv_id"""


@query(_repair_sql())
def op11_repair_turns(spark: SparkSession, folder: str) -> DataFrame:
    given = spark.read.parquet(f"{folder}/conversations.parquet")
    damaged = damaged_turns(given)
    videos, turns = turn_repair.repair_turns(damaged)
    digests = turn_repair.turns_digest(turns).withColumnRenamed("video_id", "_digest_of")
    told = given.select("conv_id").distinct().join(videos, F.col("conv_id").eqNullSafe(F.col("video_id")), "left")
    told = told.join(digests, F.col("conv_id").eqNullSafe(F.col("_digest_of")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return told.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """The conversations' rows as turns of a dialogue, damaged by a checksum of their place."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("ord"), space("role").alias("role"), space("text").alias("said"), code.alias("_code"))
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("said", "[.!?]", "")).otherwise(F.col("said"))
    twice = F.explode(F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter("_code <> 0").withColumns(
        {"speaker": F.when(F.col("_code") == 4, "user").otherwise(F.col("role")), "text": text, "_twice": twice}
    ).select("video_id", "ord", "speaker", "text")


#: Kinds of the base, in the order of spans with one start.
SECRETS = ("assign", "access", "hex")


def _secret_sql() -> str:
    """The rules in DuckDB: pieces between matches and the matches give the places."""
    parts = []
    for i, (name, rule) in enumerate(secret_scan.RULES.items()):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"""select doc_id, text, row_nr, '{name}' as kind, {i} as nr, {rule.least} as least, string_split_regex(t, '{pattern}') as gaps,
            regexp_extract_all(t, '{pattern}') as hits, regexp_extract_all(t, '{pattern}', {rule.group}) as parts from docs"""
        )
    return f"""with docs as (select *, coalesce(text, '') as t, row_number() over () as row_nr from documents),
      m as ({' union all '.join(parts)}),
      e as (select row_nr, kind, nr, least, unnest(range(1, len(hits) + 1)) as i, gaps, hits, parts from m),
      p as (select row_nr, kind, nr, least, i, length(gaps[i]) as gap, length(hits[i]) as len, length(parts[i]) as part from e),
      s as (select row_nr, kind, nr, part >= least as good, cast(sum(gap + len) over (partition by row_nr, nr order by i) as bigint) as fin, len from p),
      g as (select row_nr, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
        count(*) filter (kind = 'hex') as n_hex, string_agg(kind || ':' || (fin - len) || ':' || fin, ',' order by fin - len, nr) filter (nr < 3) as base,
        string_agg(kind || ':' || (fin - len) || ':' || fin, ',' order by fin - len, nr) as spans from s where good group by 1)
      select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
        sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from docs left join g using (row_nr)"""


@query(_secret_sql())
def op12_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    texts = documents(spark, folder).select("video_id", "transcript")
    found = secret_scan.scan_versions(texts).paths
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["rule"].isin(*SECRETS))
    return found.select(
        F.col("video_id").alias("doc_id"), *[secret_scan.count_of(spans, k).alias(f"n_{k}") for k in SECRETS],
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(spans).alias("spans"),
    )


@query("""with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as vector from embeddings where vec_id is not null and label is not null
    and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  s as (select a.vec_id as anchor_id, v.vec_id, a.label = v.label as same, cast(list_dot_product(a.vector, v.vector) as bigint) as score
    from v a join v on v.vec_id <> a.vec_id where a.vec_id % 100 = 0),
  p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
  select anchor_id, positive_id, cast(row_number() over w as int) as rank, s.vec_id as negative_id, positive_score, score as negative_score
  from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
  window w as (partition by anchor_id, positive_id order by score desc, s.vec_id) qualify row_number() over w <= 5""")
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    # Every seventh label is moved on, which makes negatives of true positives.
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(moved, moved.filter("vec_id % 100 = 0"))
