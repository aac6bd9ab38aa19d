"""Queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.session import cut

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP3_SQL = """
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
it as (
  select distinct item_id, l, array_to_string(w[s:s + l - 1], ' ') win
  from (select item_id, w, least(len(w), 13) l, unnest(range(1, len(w) - least(len(w), 13) + 2)) s from iw where len(w) > 0)),
lens as (select distinct l from it),
dt as (
  select doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') win
  from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) s from dw, lens where len(w) >= l)),
hits as (select doc_id, dt.l, s, item_id from dt join it using (l, win)),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + l)) p from hits) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(i, ',' order by i) ids from (select distinct doc_id, cast(item_id as varchar) i from hits) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from dw left join words using (doc_id) left join items using (doc_id)
"""


@query("op3_winnowing", OP3_SQL)
def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm.winnowing import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP7_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
sh as (
  select distinct doc_id, hash(array_to_string(w[i:i + least(len(w), 5) - 1], ' ')) g
  from (select doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from sh group by doc_id),
shared as (select a.doc_id x, b.doc_id y, count(*) c from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select x, y from shared join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)),
edges as (select x, y from links union all select y, x from links),
reach(a, b) as (select x, x from edges union select r.a, e.y from reach r join edges e on e.x = r.b),
comp as (select a, min(b) c from reach group by a)
select w.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, coalesce(c, w.doc_id) component_id
from w left join n using (doc_id) left join comp on comp.a = w.doc_id
"""


@query("op7_sigtree", OP7_SQL)
def op7_sigtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm.sigtree import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op4_langid")
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm import langid

    documents = table(spark, sf_dir, "documents")
    machines = langid.fit(documents, ~langid.held_out())
    out = langid.predict(documents.select("doc_id", F.col("text").cast("string").alias("text")), machines)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op10_wfst")
def op10_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from parcelspark.llm import wfst

    model = wfst.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    out = wfst.encode(table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", "n_ids", "ids", "round_trip", "decoded_sha256")


@query("op1_secrets")
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm import secrets

    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


@query("op8_tokenfile")
def op8_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from parcelspark.llm import tokenfile

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    manifest = tokenfile.write(table(spark, sf_dir, "documents"), definition, end_id=2)
    return tokenfile.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op9_ctph")
def op9_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm import ctph

    return ctph.with_next(table(spark, sf_dir, "documents"))


OP6_SQL = """
with p as (select page_id, coalesce(html, '') html from pages),
d as (select page_id, strlen(html) payload_bytes, sha1(html) h, min(page_id) over (partition by html) first from p)
select page_id, cast(payload_bytes as bigint) payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + cast((cast('0x' || substr(h, 1 + 5 * cast(i // 4 as int), 5) as bigint) >> cast(15 - 5 * (i % 4) as int)) & 31 as int), 1)), '') payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to
from d
"""


@query("op6_warc", OP6_SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm import warc

    return warc.read(warc.write(table(spark, sf_dir, "pages"))).drop("payload")


OP5_SQL = """
with m as (select distinct conv_id, turn, role, coalesce(text, '') text from conversations),
p as (select distinct conv_id, role speaker from m where role is not null and role <> 'system'),
r as (
  select m.conv_id, speaker, turn, m.role, text, floor(turn / 64) part,
    case when m.role is null then '<|user|>' || chr(10) when m.role = 'system' then '<|system|>' || chr(10) when m.role = speaker then '<|assistant|>' || chr(10)
      else '<|user name=' || m.role || '|>' || chr(10) end head
  from m join p using (conv_id)),
s as (
  select *, head || text || '<|end|>' || chr(10) piece,
    coalesce(sum(length(head) + length(text) + 8) over (partition by conv_id, speaker order by turn, role nulls first, text rows between unbounded preceding and 1 preceding), 0) start
  from r)
select conv_id, speaker, cast(dense_rank() over (partition by conv_id, speaker order by part) - 1 as bigint) part, cast(count(*) as bigint) n_messages, cast(min(start) as bigint) start,
  string_agg(piece, '' order by turn, role nulls first, text) rendered,
  coalesce(string_agg(case when role = speaker then (start + length(head)) || ':' || (start + length(piece)) end, ',' order by turn, role nulls first, text), '') masks
from s group by conv_id, speaker, s.part
"""


@query("op5_rotation", OP5_SQL)
def op5_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm import chat

    out = chat.rotate(table(spark, sf_dir, "conversations"))
    masks = F.concat_ws(",", F.transform("masks", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))
    return out.withColumn("masks", masks)


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm import toxicity

    documents = table(spark, sf_dir, "documents")
    index = toxicity.fit(documents, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    out = toxicity.score(documents.select("doc_id", F.col("text").cast("string").alias("text")), index)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def _op11_sql(k: int = 8, rounds: int = 10) -> str:
    squared = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes = [
        """kept as materialized (
  select row_number() over () r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
        f"""c0 as materialized (
  select row_number() over (order by sha256('3:' || coalesce(cast(vec_id as varchar), '')), v) - 1 j, v c from kept qualify j < {k})""",
    ]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} as materialized (
  select r, any_value(vec_id) vec_id, any_value(v) v, min(struct_pack(d := d, j := j)) near from (select r, vec_id, v, j, {squared} d from kept, c{i}) group by r)""")
        if i < rounds:
            ctes.append(f"""c{i + 1} as materialized (
  select j, coalesce(m, c) c from c{i} left join (
    select j, list((s - ((s % n) + n) % n) // n order by p) m
    from (select near.j j, p, sum(v[p]) s, count(*) n from a{i}, range(1, 65) t(p) group by near.j, p) group by j) using (j))""")
    return f"""with {", ".join(ctes)}
select vec_id, cast(near.j as int) as "cluster", cast(near.d as bigint) distance, cast(sum(near.d) over (partition by near.j) as bigint) cluster_inertia,
  cast(sum(near.d) over () as bigint) inertia, sha256(array_to_string(c, ',')) centroid_sha256
from a{rounds} join c{rounds} on c{rounds}.j = near.j
"""


@query("op11_centroids", _op11_sql())
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm import centroids

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out, places = centroids.cluster(vectors)
    digests = F.transform(F.array(*[F.lit(",".join(map(str, c))) for c in places] or [F.lit("")]), lambda c: F.sha2(c, 256))
    return out.withColumnRenamed("id", "vec_id").withColumn("centroid_sha256", F.get(digests, F.col("cluster")))


OP12_SQL = """
with d as (
  select doc_id, coalesce(text, '') text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) s,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') t from documents),
h as (
  select *, cast(len(t) as bigint) n, cast('0x' || substr(s, 1, 8) as bigint) h1, cast('0x' || substr(s, 9, 8) as bigint) h2,
    cast('0x' || substr(s, 17, 8) as bigint) h3, cast('0x' || substr(s, 25, 8) as bigint) h4 from d),
f as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
    case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end form from h),
p as (select *, array_to_string(t[1:a], '') prefix, array_to_string(t[a + 1:b], '') middle, array_to_string(t[b + 1:], '') suffix from f)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end prefix_chars, case when form <> 'plain' then length(middle) end middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) output_sha256,
  sha256(text) restored_sha256
from p
"""


@query("op12_fim", OP12_SQL)
def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelspark.llm import fim

    return fim.forms(fim.plan(cut(fim.store(table(spark, sf_dir, "documents")))))


@query("op13_bpe")
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from parcelspark.llm import bpe

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), definition), definition)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
