"""The numbered queries: each operator over its whole table, with the columns asked for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import corpus_pipeline
from censora.llm import bpe, chat, exact, inner, packing, pairwise, perplexity, pii, repair, sharding, simhash, trie, warc
from censora.queries import Query, Tables
from censora.session import materialise, shared_dir

TOKENIZER = "byte_bpe_50k.json"
QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = Query(name, build, sql)
        return build

    return register


@query("op1_pii")
def personal_data(t: Tables) -> DataFrame:
    found = pii.find(t.documents)
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


@query("op2_quality")
def quality(t: Tables) -> DataFrame:
    ranking = pairwise.train(t.documents, t.labels)
    scored = pairwise.scored(t.documents.select("doc_id", "text"), ranking)
    return scored.select("doc_id", (~pairwise.learnable(F.col("doc_id"))).alias("held_out"), "score", "predicted")


@query("op3_shards")
def shards(t: Tables) -> DataFrame:
    found = sharding.sharded(t.documents, 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op4_inner_product",
    """
    WITH whole AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
      SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
      FROM whole q JOIN whole x ON x.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
    )
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
    QUALIFY rank <= 20
    """,
)
def inner_product(t: Tables) -> DataFrame:
    return inner.top_k(t.embeddings, F.col("id") % 20 == 0, 20)


@query(
    "op5_warc",
    """
    WITH hashed AS (
      SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS hex FROM pages
    ), digits AS (
      SELECT *, max(page_id) OVER (PARTITION BY hex) AS latest,
        list_transform(range(41), lambda i: instr('0123456789ABCDEF', substr(hex || '0', i::INT + 1, 1)) - 1) AS d FROM hashed
    )
    SELECT page_id, payload_bytes,
      array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((d[(5 * i) // 4 + 1] * 16 + d[(5 * i) // 4 + 2]) >> (3 - (5 * i) % 4)) & 31) + 1)::INT, 1)), '') AS payload_digest,
      CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> latest THEN latest END AS refers_to
    FROM digits
    """,
)
def archives(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "warc")
    warc.write_pages(t.pages, path)
    number = lambda c: F.nullif(F.regexp_extract(c, "^urn:x-page:(.*)$", 1), F.lit("")).cast("long")
    columns = "record_id string, record_type string, payload_digest string, refers_to string, http_length long, payload binary"
    found = warc.read_pages(t.spark, path, columns).where(F.col("record_type").isin("response", "revisit"))
    # What a response holds is measured; a revisit holds nothing, so its headers speak for it.
    response = F.col("record_type") == "response"
    return found.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(response, base32(F.sha1("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def base32(sha1: Column) -> Column:
    """A SHA-1 of 40 hexadecimal digits in base 32: forty bits at a time."""
    digits = [F.lpad(F.conv(F.substring(sha1, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


@query("op6_packing")
def best_fit_packing(t: Tables) -> DataFrame:
    packed = packing.packed_documents(t.documents, public_tokenizers.path(TOKENIZER), 2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query(
    "op7_chat_tree",
    """
    WITH said AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), escapes AS (
      SELECT *, len(regexp_extract_all(role || chr(10) || text, '[<\\[|]\\\\*(\\||>|/?s>|/?INST\\])')) AS extra FROM said
    )
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(length(role) + length(text) + 8 + extra)::BIGINT AS formatted_chars
    FROM escapes GROUP BY conv_id
    """,
)
def chat_tree(t: Tables) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = t.spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    packed = chat.sequences(t.conversations.select("conv_id", "turn", "role", "text").unionByName(added))
    return chat.read_back(materialise(packed, "chat"))


@query("op8_bpe")
def encoded(t: Tables) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    ids = bpe.encode(t.documents, path)
    both = bpe.decode(ids, path, keep=("doc_id", "ids"))
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )


@query("op9_perplexity")
def quality_rules(t: Tables) -> DataFrame:
    judged = perplexity.judged(t.documents.select("doc_id", "lang", "text"))
    return judged.select("doc_id", *perplexity.Measures._fields, "base_failed", "kept", "log_perplexity")


@query("op10_simhash")
def near_duplicates(t: Tables) -> DataFrame:
    found = simhash.near_duplicates(t.documents)
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


@query(
    "op11_exact",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def exact_duplicates(t: Tables) -> DataFrame:
    return exact.marks(t.documents).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB."""
    bits = "list_reduce(range(8)::UBIGINT[], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END, xor(c, b))"
    codes = f"list_transform(range(length({text})), lambda i: ascii(substr({text}, i::INT + 1, 1))::UBIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: {bits}, 4294967295::UBIGINT), 4294967295::UBIGINT)"


# First turns that a conversation may take over from the first one of its hundred.
TAKEN, HUNDRED = 6, 100


@query(
    "op12_trie",
    f"""
    WITH RECURSIVE said AS (
      SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ), heads AS (SELECT *, conv_id - conv_id % {HUNDRED} AS base, ({_crc32_sql("conv_id::VARCHAR")} % {TAKEN})::BIGINT AS h FROM said
    ), rebuilt AS (
      SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns FROM heads c LEFT JOIN said b ON b.conv_id = c.base
    ), prefixes AS (
      SELECT conv_id, 0 AS depth, md5('') AS key, NULL::VARCHAR AS parent_key, turns, 0 AS chars FROM rebuilt
      UNION ALL
      SELECT conv_id, depth + 1, md5(key || md5(turns[depth + 1].r) || turns[depth + 1].t), key, turns, length(turns[depth + 1].t) FROM prefixes WHERE depth < len(turns)
    ), found AS (
      SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent_key) AS parent_key, count(*) AS n_convs, any_value(chars) AS chars,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len(turns)), '')) AS ends_sha256
      FROM prefixes GROUP BY key
    ), nodes AS (
      SELECT f.*, coalesce(k.n, 0) AS n_children FROM found f LEFT JOIN (SELECT parent_key AS key, count(*) AS n FROM found GROUP BY 1) k USING (key)
    ), climb AS (
      SELECT key AS top, parent_key AS up, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * chars AS saved FROM nodes
      UNION ALL
      SELECT n.key, n.parent_key, c.leaf, c.saved FROM climb c JOIN nodes n ON n.key = c.up
    ), sums AS (SELECT top AS key, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM climb GROUP BY top)
    SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
    FROM nodes n JOIN sums s USING (key) LEFT JOIN nodes p ON p.key = n.parent_key
    """,
)
def prefix_trie(t: Tables) -> DataFrame:
    said = materialise(trie.turn_keys(t.conversations), "turns")
    own, base = F.col("conv_id"), F.col("conv_id") - F.col("conv_id") % HUNDRED
    heads = said.where(own % HUNDRED == 0).select(own.alias("_base"), F.slice("turns", 1, TAKEN).alias("_head"))
    h = (F.crc32(own.cast("string").cast("binary")) % TAKEN).cast("int")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    head = F.when(F.col("_head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("_head", 1, h))
    rebuilt = said.withColumn("_base", base).join(heads, "_base", "left").select("conv_id", F.concat(head, rest).alias("turns"))
    return trie.nodes(rebuilt)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as a careless export leaves them, by a hash of conversation and turn: dropped, emptied, unended, repeated, misattributed."""
    space = F.lit(" ")
    filled = lambda c: F.coalesce(F.col(c).cast("string"), space)
    how = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), how.alias("_how")).where("_how <> 0")
    text = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("_how") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("_how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


@query("op13_repair")
def structure_repair(t: Tables) -> DataFrame:
    rows = damaged(t.conversations)
    audited = materialise(repair.audits(rows), "audits")
    hashed = repair.digests(repair.repaired(rows, audited))
    whole = audited.join(hashed, audited["conv_id"].eqNullSafe(hashed["conv_id"]), "left").drop(hashed["conv_id"]).withColumnRenamed("conv_id", "_conv_id")
    every = t.conversations.select("conv_id").distinct()
    joined = every.join(whole, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query("pipeline")
def pipeline(t: Tables) -> DataFrame:
    return corpus_pipeline.run(t.spark, t.directory)


def load() -> dict[str, Query]:
    return QUERIES
