"""The operators over the test tables, with the SQL their results must equal where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, embeddings, langid, lines, merkle, mixing, pii, repair, secrets, simhash, spans, substrings, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(build):
    """Register a query under its function's name."""
    QUERIES[build.__name__] = build
    return build


def fold(parts: int):
    """crc32 of the document's id as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


@query
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"), "score", "predicted").withColumn("held_out", fold(5) == 0)


@query
def op2_embeddings(spark, sf_dir):
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query
def op3_decontaminate(spark, sf_dir):
    found = decontaminate.longest_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda match: match["item"])))
    hits = decontaminate.hit_words(F.col("matches"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hits.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("matches") > 0).alias("contaminated"))


@query
def op4_pii(spark, sf_dir):
    found = pii.find_personal_data(table(spark, sf_dir, "documents"), with_text=False)
    count = lambda kind: F.size(F.filter("base", lambda span: span["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), *[count(kind) for kind in pii.KINDS[:4]],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query
def op5_substrings(spark, sf_dir):
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda total, span: total + span["end"] - span["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold(3) != 1))
    return langid.identify(docs, model).select(
        F.col("id").alias("doc_id"), "lang_pred", "score", "rejected").withColumn("held_out", fold(3) == 1)


@query
def op7_simhash(spark, sf_dir):
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    printed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return groups.select(F.col("id").alias("doc_id"), printed.alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op8_lines(spark, sf_dir):
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"), length_column="n_chars")
    return kept.select("doc_id", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op9_chat(spark, sf_dir):
    return chat.render_turns(table(spark, sf_dir, "conversations")).withColumnRenamed("conversation", "conv_id")


@query
def op10_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


@query
def op11_merkle(spark, sf_dir):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    versions = merkle.manifest(table(spark, sf_dir, "documents"), changes={"text": lower}, changed=fold(5) == 0)
    return versions.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified")


@query
def op12_secrets(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    kinds = [rule.kind for rule in secrets.BASE]
    base = F.filter("spans", lambda span: span["rank"] < len(kinds))
    count = lambda kind: F.size(F.filter("spans", lambda span: span["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), *[count(kind) for kind in kinds], F.sha2(spans.listed(base), 256).alias("base_sha256"),
        spans.listed(F.col("spans")).alias("spans"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with a twentieth of their rows each dropped, emptied, without sentence ends, said twice or given to the user."""
    plain = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")), F.lit(20))
    return turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind")).where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


@query
def op13_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    found = repair.repair_summary(damaged(turns))
    numbers = [F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conversation")), "left").select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


ORACLE["op10_mixing"] = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank
  FROM rows GROUP BY source),
weighted AS (SELECT *, 3 * source_size AS room, CASE (source_rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
-- the level at which sources that reach their room are full and the others share the rest by weight
levels AS (
  SELECT 0 AS step, (SELECT sum(source_size) FROM weighted)::DOUBLE / (SELECT sum(weight) FROM weighted) AS level
  UNION ALL
  SELECT step + 1, (
    SELECT (sum(source_size)::BIGINT - coalesce(sum(room) FILTER (room < level * weight), 0)::BIGINT)::DOUBLE
           / (sum(weight) FILTER (room >= level * weight)) FROM weighted)
  FROM levels WHERE step < 60),
targets AS (
  SELECT source, source_rank, source_size, least(room::DOUBLE, (SELECT max(level) FROM levels) * weight) AS target FROM weighted),
queued AS (
  SELECT doc_id, digest, source_rank, size, source_size, target,
         sum(size) OVER (PARTITION BY source_rank ORDER BY digest, doc_id)::BIGINT AS so_far
  FROM rows JOIN targets ON rows.source IS NOT DISTINCT FROM targets.source WHERE size > 0),
copies AS (
  SELECT *, (copy * source_size + so_far)::DOUBLE / target AS finish FROM queued, (SELECT unnest([0, 1, 2]) AS copy)),
spent AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source_rank, copy, digest, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent
  FROM copies),
taken AS (
  SELECT doc_id, count(*) AS copies FROM spent WHERE spent <= (SELECT sum(size) FROM rows) GROUP BY doc_id)
SELECT rows.doc_id, rows.size, source_size, target, coalesce(taken.copies, 0)::BIGINT * rows.size AS taken, rows.source,
       coalesce(taken.copies, 0)::BIGINT AS copies
FROM rows JOIN targets ON rows.source IS NOT DISTINCT FROM targets.source LEFT JOIN taken ON rows.doc_id = taken.doc_id
"""

ORACLE["op3_decontaminate"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS piece
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS i FROM items WHERE len(words) > 0)),
pieces AS (SELECT DISTINCT size, piece FROM windows),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM docs),
found AS (
  SELECT DISTINCT doc_id, i, sizes.size, array_to_string(words[i:i + sizes.size - 1], ' ') AS piece
  FROM starts, (SELECT DISTINCT size FROM pieces) sizes WHERE i + sizes.size - 1 <= len(words)
  AND array_to_string(words[i:i + sizes.size - 1], ' ') IN (SELECT piece FROM pieces)),
exact AS (SELECT found.* FROM found JOIN pieces USING (size, piece)),
hits AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS w FROM exact) GROUP BY doc_id),
held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM exact JOIN windows USING (size, piece)) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN held USING (doc_id)
"""

ORACLE["op9_chat"] = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turn_no, role, text
  FROM conversations),
whole AS (
  SELECT conv_id, count(*) AS n_turns, list(struct_pack(r := role, t := text) ORDER BY turn_no) AS said FROM turns GROUP BY conv_id),
snapshots AS (
  SELECT DISTINCT a.conv_id FROM whole a JOIN whole b
    ON a.said[1] IS NOT DISTINCT FROM b.said[1] AND a.said = b.said[1:a.n_turns]
   AND (b.n_turns > a.n_turns OR (b.n_turns = a.n_turns AND b.conv_id < a.conv_id)))
SELECT conv_id, turn_no, n_turns,
       '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS segment
FROM turns JOIN whole USING (conv_id) WHERE conv_id NOT IN (SELECT conv_id FROM snapshots)
"""


def _crc32(value: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII text: the reflected polynomial, bit by bit; each character goes in before its first bit."""
    bits = f"list_transform(range(8 * len({value})), lambda k: CASE WHEN k % 8 = 0 THEN ascii(substr({value}, (k // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT)"
    step = "xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: {step}), 4294967295)"


_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(name) for name in ("doc_id", "source", "lang", "n_chars", "{text}")) + "))"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SIBLINGS = """
  SELECT *, coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, position // 16 ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, position // 16 ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {0} WHERE total > 1"""
_NEXT_LEVEL = """
  SELECT tree, level + 1, position // 16, CAST((any_value(total) + 15) // 16 AS BIGINT), sha256(string_agg(digest, '' ORDER BY position))
  FROM {0} WHERE total > 1 GROUP BY tree, level, position // 16"""

ORACLE["op11_merkle"] = f"""
WITH RECURSIVE sources AS (
  SELECT source AS named, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)),
rows AS (
  SELECT doc_id, tree, {_LEAF.format(text="text")} AS leaf,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_LEAF.format(text=_LOWER)} END AS changed
  FROM documents JOIN sources ON source IS NOT DISTINCT FROM named),
leaves AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS position,
         count(*) OVER (PARTITION BY tree) AS total FROM rows),
levels AS (
  SELECT tree, 0 AS level, position, total, leaf AS digest FROM leaves
  UNION ALL {_NEXT_LEVEL.format("levels")}),
subroots AS (SELECT tree, digest AS subroot FROM levels WHERE total = 1),
tops AS (
  SELECT 0::BIGINT AS tree, 0 AS level, CAST(tree AS BIGINT) AS position, count(*) OVER () AS total, subroot AS digest FROM subroots
  UNION ALL {_NEXT_LEVEL.format("tops")}),
low AS ({_SIBLINGS.format("levels")}),
high AS ({_SIBLINGS.format("tops")}),
path AS (
  SELECT leaves.tree, leaves.position, level, l, r FROM leaves JOIN low
    ON low.tree = leaves.tree AND low.position = leaves.position // CAST(pow(16, level) AS BIGINT)
  UNION ALL
  SELECT leaves.tree, leaves.position, 100 + level, l, r FROM leaves JOIN high ON high.position = leaves.tree // CAST(pow(16, level) AS BIGINT)),
paths AS (
  SELECT tree, position, string_agg(l || r, '' ORDER BY level) AS proof, list(struct_pack(l := l, m := '', r := r) ORDER BY level) AS steps
  FROM path GROUP BY tree, position),
folded AS (
  SELECT doc_id, leaf, subroot, (SELECT digest FROM tops WHERE total = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(list_prepend(struct_pack(l := '', m := coalesce(changed, leaf), r := ''), coalesce(steps, [])),
           lambda a, b: struct_pack(l := '', m := sha256(b.l || a.m || b.r), r := '')).m AS folded_root
  FROM leaves JOIN subroots USING (tree) LEFT JOIN paths USING (tree, position))
SELECT *, folded_root = root AS verified FROM folded
"""

_ASSIGN = (
    """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    """["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""")
_RULES = [
    ("assign", _ASSIGN, f"len(regexp_extract(value, '{_ASSIGN}', 2)) >= 6"), ("access", "AKIA[A-Z0-9]+", "len(value) >= 20"),
    ("hex", "[0-9a-f]{24,}", "true"), ("private_key", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "true"),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", "true"), ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    ("google", "AIza[A-Za-z0-9_-]{35}", "true"), ("stripe", "[rs]k_live_[A-Za-z0-9]{16,}", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,900}\.eyJ[A-Za-z0-9_-]{8,900}\.[A-Za-z0-9_-]+", "true"),
    ("credentials", r"[a-z]{2,20}://[A-Za-z0-9._-]{1,100}:[^\x00-\x20/@:]{1,100}@[A-Za-z0-9.-]+", "true")]

ORACLE["op12_secrets"] = "WITH found AS (" + " UNION ALL ".join(f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, unnest(regexp_extract_all(text, '{pattern}')) AS value,
         unnest(list_transform(regexp_split_to_array(text, '{pattern}')[:len(regexp_extract_all(text, '{pattern}'))], lambda x: len(x))) AS gap,
         generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS nth
  FROM documents""" for rank, (kind, pattern, _) in enumerate(_RULES)) + """),
placed AS (SELECT *, sum(gap + len(value)) OVER (PARTITION BY doc_id, rank ORDER BY nth)::BIGINT AS upto FROM found),
kept AS (SELECT doc_id, rank, kind, upto - len(value) AS start, kind || ':' || (upto - len(value)) || ':' || upto AS span FROM placed
  WHERE """ + " AND ".join(f"(kind <> '{kind}' OR {check})" for kind, _, check in _RULES[:2]) + """)
SELECT documents.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex, sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM documents LEFT JOIN kept ON documents.doc_id = kept.doc_id GROUP BY documents.doc_id
"""

# Cheapest rest of a conversation from row i and each state, as cost and edits; I and R are followed by the new role's initial
_LEAST = "list_min([{0}])"


def _turn(state: int, kept: str) -> str:
    """The cheapest way on through the next row from a state, without inserting before it."""
    after, wanted = (2, 2, 3, 2)[state], "uuau"[state]
    say = lambda cost, letters, to: f"struct_pack(c := {cost} + dp.s{to}.c, e := '{letters}' || dp.s{to}.e)"
    far = "struct_pack(c := 1000000, e := '')"
    options = [say("4", "D", state), f"CASE WHEN bound THEN {far} ELSE {say('3 + extra', 'R' + wanted, after)} END"]
    options += [f"CASE WHEN bound OR initial <> '{role}' THEN {far} ELSE {say('extra', 'K', to)} END" for role, to in zip(kept, {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}[state])]
    return _LEAST.format(", ".join(options))


def _or_insert(state: int) -> str:
    """The cheapest way on from a state: through the row at once, or after one or two inserts."""
    chain, options, letters = (2, 2, 3, 2), [f"t{state}"], ""
    for count in (1, 2):
        letters += "I" + "uuau"[state]
        state = chain[state]
        options.append(f"struct_pack(c := {3 * count} + t{state}.c, e := '{letters}' || t{state}.e)")
    return _LEAST.format(", ".join(options))


ORACLE["op13_repair"] = f"""
WITH RECURSIVE plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hit AS (SELECT *, {_crc32("name")} % 20 AS kind FROM plain),
turns AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM turns),
faults AS (
  SELECT *, role[1] AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
sized AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
dp AS (
  SELECT conv_id, n + 1 AS i, struct_pack(c := 0, e := '') AS s0, struct_pack(c := 6, e := 'IuIa') AS s1,
         struct_pack(c := 3, e := 'Ia') AS s2, struct_pack(c := 0, e := '') AS s3 FROM sized
  UNION ALL
  SELECT conv_id, i, {_or_insert(0)}, {_or_insert(1)}, {_or_insert(2)}, {_or_insert(3)} FROM (
    SELECT conv_id, i, {_turn(0, "su")} AS t0, {_turn(1, "u")} AS t1, {_turn(2, "a")} AS t2, {_turn(3, "u")} AS t3 FROM (
      SELECT dp.conv_id, dp.i - 1 AS i, struct_pack(s0 := s0, s1 := s1, s2 := s2, s3 := s3) AS dp, initial, fault IN ('blank', 'duplicate') AS bound,
             CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS extra
      FROM dp JOIN faults ON faults.conv_id IS NOT DISTINCT FROM dp.conv_id AND faults.i = dp.i - 1))),
best AS (SELECT conv_id, s0.c AS cost, regexp_extract_all(s0.e, '[DIKR][ua]?') AS steps FROM dp WHERE i = 1),
steps AS (
  SELECT conv_id, step, j, sum(CASE WHEN step[1] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY j) AS i
  FROM (SELECT conv_id, unnest(steps) AS step, generate_subscripts(steps, 1) AS j FROM best)),
said AS (
  SELECT steps.conv_id, string_agg(CASE step[2] WHEN 'u' THEN 'user' WHEN 'a' THEN 'assistant' ELSE role END || ':' ||
    CASE step[1] WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) FILTER (step <> 'D') AS repaired
  FROM steps LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM steps.conv_id AND faults.i = steps.i GROUP BY steps.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(regexp_replace(array_to_string(steps, ''), '[ua]', '', 'g'), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sized ON o.conv_id IS NOT DISTINCT FROM sized.conv_id
LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN said ON o.conv_id IS NOT DISTINCT FROM said.conv_id
"""
