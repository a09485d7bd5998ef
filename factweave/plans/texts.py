"""Registered queries: functions on texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.operators import atoms as A
from factweave.plans.registry import query
from factweave.sources.views import STRATEGIES


def _q(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query("c1_content_key", "SELECT memory_id, content_key, sha256('rbac:group:g1' || chr(0) || lower(memory_type) || chr(0) || lower(trim(regexp_replace(content, '\\s+', ' ', 'g')))) AS scoped_key FROM memories")
def c1(v):
    return v.memories.select("memory_id", T.content_key("content", "memory_type").alias("content_key"), T.content_key("content", "memory_type", F.lit("rbac:group:g1")).alias("scoped_key"))


_TOKENS = f"list_filter(regexp_extract_all(lower({{}}), '[\\p{{{{L}}}}\\p{{{{N}}}}_]+'), lambda w: octet_length(encode(w)) > 2 AND NOT list_contains({_q(T.STOPWORDS)}, w))".replace("{{", "{").replace("}}", "}")


def tokens_sql(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: octet_length(encode(w)) > 2 AND NOT list_contains({_q(T.STOPWORDS)}, w))"


@query("c2_bm25_tokenize", f"SELECT memory_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT memory_id, {tokens_sql('content')} AS t FROM memories)")
def c2(v):
    t = v.memories.select("memory_id", T.bm25_tokens("content").alias("t"))
    return t.select("memory_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


def subject_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 4 AND NOT list_contains({_q(T.FILLERS)}, w))"


@query("c3_shares_subject", f"SELECT a.memory_id, len({subject_sql('a.content')}) = 0 OR list_has_any({subject_sql('a.content')}, {subject_sql('b.content')}) AS shares FROM memories a JOIN memories b ON b.doc_id = a.doc_id + 1")
def c3(v):
    b = v.memories.select((F.col("doc_id") - 1).alias("doc_id"), F.col("content").alias("other"))
    return v.memories.join(b, "doc_id").select("memory_id", T.shares_subject("content", "other").alias("shares"))


def _marked(column: str) -> str:
    # the texts hold few markers, so some are put in by the id
    return f"""CASE doc_id % 6 WHEN 0 THEN 'We tested the first plan. ' || left({column}, 60) || ' but ' || substr({column}, 61) WHEN 1 THEN left({column}, 40) || ' because ' || substr({column}, 41) WHEN 2 THEN left({column}, 40) || ', is part of ' || substr({column}, 41)
        WHEN 3 THEN left({column}, 30) || ' therefore ' || substr({column}, 31) || ' because of it' WHEN 4 THEN left({column}, 40) || '; is a kind of ' || substr({column}, 41) ELSE {column} END"""


_MARKED = {"marked": f"SELECT memory_id, doc_id, replace({_marked('content')}, chr(10), ' ') AS text FROM memories"}


def marked(v):
    d, t = F.col("doc_id") % 6, F.col("content")
    left, rest = lambda n: F.substring(t, 1, n), lambda n: F.substring(t, n + 1, 1 << 30)
    text = (
        F.when(d == 0, F.concat(F.lit("We tested the first plan. "), left(60), F.lit(" but "), rest(60)))
        .when(d == 1, F.concat(left(40), F.lit(" because "), rest(40)))
        .when(d == 2, F.concat(left(40), F.lit(", is part of "), rest(40)))
        .when(d == 3, F.concat(left(30), F.lit(" therefore "), rest(30), F.lit(" because of it")))
        .when(d == 4, F.concat(left(40), F.lit("; is a kind of "), rest(40)))
        .otherwise(t)
    )
    return v.memories.select("memory_id", "doc_id", F.replace(text, F.lit("\n"), F.lit(" ")).alias("text"))


_CONTRAST = " OR ".join(f"contains(lower(text), '{m}')" for m in T.CONTRASTS)


@query("c4_is_coherent", f"""SELECT memory_id, NOT (len(list_filter(regexp_split_to_array(text, '[.!?]'), lambda s: octet_length(encode(trim(s))) > 10)) > 1 AND ({_CONTRAST})
    AND len(list_distinct(list_transform(list_filter(regexp_split_to_array(lower(text), '[.;,]'), lambda s: octet_length(encode(trim(s))) > 5), lambda s: string_split(trim(s), ' ')[1]))) > 1) AS coherent FROM marked""", _MARKED)
def c4(v):
    return marked(v).select("memory_id", T.is_coherent("text").alias("coherent"))


def _parts_sql(table, body) -> str:
    cases = " ".join(f"WHEN contains(lower(text), '{m}') THEN {body(k, m, t)}" for k, (m, t) in enumerate(table))
    return f"CASE {cases} END"


_FIRST = "trim(left(text, instr(lower(text), '{m}') - 1))"
_SECOND = "trim(substr(text, instr(lower(text), '{m}') + {n}))"


@query("c5_split_incoherent", "SELECT memory_id, unnest(parts) AS part_text FROM (SELECT memory_id, CASE " + " ".join(
    f"WHEN contains(lower(text), '{m}') AND octet_length(encode({_FIRST.format(m=m)})) > 10 AND octet_length(encode({_SECOND.format(m=m, n=len(m))})) > 10 THEN [{_FIRST.format(m=m)}, {_SECOND.format(m=m, n=len(m))}]" for m in T.CONTRASTS[:5]) + " ELSE [text] END AS parts FROM marked)", _MARKED)
def c5(v):
    return A.split_rows(marked(v), "text").select("memory_id", "part_text")


@query("c6_split_causal", "SELECT * FROM (SELECT memory_id, " + _parts_sql(T.CAUSAL, lambda k, m, second: (_SECOND if second else _FIRST).format(m=m, n=len(m))) + " AS cause, " + _parts_sql(T.CAUSAL, lambda k, m, second: (_FIRST if second else _SECOND).format(m=m, n=len(m))) + " AS effect FROM marked) WHERE cause <> '' AND effect <> ''", _MARKED)
def c6(v):
    return marked(v).select("memory_id", T.split_causal("text").alias("s")).where("s is not null").select("memory_id", "s.*")


_STRUCTURAL = "SELECT * FROM (SELECT memory_id, " + _parts_sql(T.STRUCTURAL, lambda k, m, e: f"'{e}'") + " AS edge_type, regexp_replace(" + _parts_sql(T.STRUCTURAL, lambda k, m, e: _FIRST.format(m=m)) + ", '[,;]+$', '') AS from_text, " + _parts_sql(T.STRUCTURAL, lambda k, m, e: _SECOND.format(m=m, n=len(m))) + " AS to_text FROM marked) WHERE from_text <> '' AND to_text <> ''"


@query("c7_split_structural", _STRUCTURAL, _MARKED)
def c7(v):
    return marked(v).select("memory_id", T.split_structural("text").alias("s")).where("s is not null").select("memory_id", "s.*")


def _atoms(v):
    """Each marked text cut at sentence ends, at the commas and after forty characters."""
    parts = F.filter(F.transform(F.split("text", r"[.,;]"), lambda x: F.btrim(x)), lambda x: x != "")
    return marked(v).select(F.col("memory_id").alias("message_id"), F.posexplode(parts).alias("nth", "text"))


_ATOMS = _MARKED | {"atoms": "SELECT memory_id AS message_id, generate_subscripts(p, 1) - 1 AS nth, unnest(p) AS text FROM (SELECT memory_id, list_filter(list_transform(regexp_split_to_array(text, '[.,;]'), lambda x: trim(x)), lambda x: x <> '') AS p FROM marked)"}
_ATOMS["clauses"] = "SELECT memory_id AS message_id, " + _parts_sql(T.CAUSAL, lambda k, m, second: (_SECOND if second else _FIRST).format(m=m, n=len(m))) + " AS cause, " + _parts_sql(T.CAUSAL, lambda k, m, second: (_FIRST if second else _SECOND).format(m=m, n=len(m))) + " AS effect FROM marked"
_HITS = "len(list_filter(regexp_split_to_array(lower(trim({s})), '\\s+'), lambda w: octet_length(encode(w)) > 3 AND contains(lower(text), w)))"
_PICK = f"""SELECT message_id, max(nth) FILTER (rc = 1) AS cause_atom, max(nth) FILTER (re = 1) AS effect_atom FROM (SELECT message_id, nth, row_number() OVER (PARTITION BY message_id ORDER BY {_HITS.format(s='cause')} DESC, nth DESC) AS rc, row_number() OVER (PARTITION BY message_id ORDER BY {_HITS.format(s='effect')} DESC, nth DESC) AS re FROM atoms JOIN clauses USING (message_id) WHERE cause <> '' AND effect <> '') GROUP BY message_id"""


@query("c8_pick_cause_effect", f"SELECT * FROM ({_PICK}) WHERE cause_atom <> effect_atom", _ATOMS)
def c8(v):
    clauses = marked(v).select(F.col("memory_id").alias("message_id"), T.split_causal("text").alias("s")).where("s is not null").select("message_id", "s.*")
    return A.pick_cause_effect(_atoms(v), clauses).select("message_id", F.col("cause_atom").cast("long").alias("cause_atom"), F.col("effect_atom").cast("long").alias("effect_atom"))


@query("c9_backstop_edges", f"""SELECT message_id, effect_atom AS src_atom, cause_atom AS dst_atom, 'BECAUSE' AS edge_type, 55 AS strength FROM ({_PICK}) WHERE cause_atom <> effect_atom AND CAST(substr(message_id, 5) AS BIGINT) % 7 <> 0
    UNION ALL SELECT p.message_id, cause_atom, effect_atom, edge_type, 60 FROM ({_PICK.replace("clauses", "structural")}) p JOIN structural USING (message_id) WHERE cause_atom <> effect_atom""", _ATOMS | {"structural": f"SELECT memory_id AS message_id, from_text AS cause, to_text AS effect, edge_type FROM ({_STRUCTURAL})"})
def c9(v):
    """All messages, whole; those whose id is a multiple of seven have a relation already, and so call for no BECAUSE."""
    m = marked(v).select(F.col("memory_id").alias("message_id"), "doc_id", "text")
    related = m.where("doc_id % 7 = 0").select("message_id", F.lit(0).alias("src_atom"), F.lit(1).alias("dst_atom"), F.lit("SUPPORTS").alias("edge_type"))
    out = A.backstop_edges(m.select("message_id", "text"), _atoms(v), related)
    return out.select("message_id", *(F.col(c).cast("long").alias(c) for c in ("src_atom", "dst_atom")), "edge_type", "strength")


def _scores_sql(table, column) -> str:
    return "[" + ", ".join("{'concept': '" + k + "', 'score': (" + " + ".join(f"contains(lower({column}), '{w}')::INT" for w in ws) + f") / {len(ws)}.0::DOUBLE}}" for k, ws in table.items()) + "]"


@query("c10_classify_concepts", f"SELECT memory_id, s.concept AS concept, round(s.score, 6) AS score FROM (SELECT memory_id, unnest({_scores_sql(T.CLASSIFIER_WORDS, 'content')}) AS s FROM memories) WHERE s.score >= 0.2")
def c10(v):
    return v.memories.select("memory_id", F.explode(T.classify_concepts("content", 0.2)).alias("s")).select("memory_id", "s.concept", F.round("s.score", 6).alias("score"))


_MAPPED = {"mapped": f"""SELECT memory_id, concept, score FROM (SELECT memory_id, s.concept AS concept, s.score AS score, row_number() OVER (PARTITION BY memory_id ORDER BY s.score DESC, s.concept) AS n FROM (SELECT memory_id, unnest({_scores_sql(T.MAPPER_WORDS, 'content')}) AS s FROM memories) WHERE s.score > 0) WHERE n <= 3""",
    "with_own": "SELECT memory_id, concept, score FROM mapped UNION ALL SELECT memory_id, upper(left(memory_type, 1)) || substr(memory_type, 2), 0.9 FROM memories m WHERE NOT EXISTS (SELECT 1 FROM mapped p WHERE p.memory_id = m.memory_id AND lower(p.concept) = m.memory_type)"}


@query("c11_map_to_concepts", "SELECT memory_id, concept, round(score, 6) AS score FROM with_own", _MAPPED)
def c11(v):
    return v.memories.select("memory_id", F.explode(T.map_to_concepts("content", "memory_type")).alias("s")).select("memory_id", "s.concept", F.round("s.score", 6).alias("score"))


@query("c12_concept_links", "SELECT memory_id, concept, CAST(floor(100 * score + 1e-9) AS INTEGER) AS confidence FROM with_own", _MAPPED)
def c12(v):
    return A.concept_links(v.memories.select("memory_id", T.map_to_concepts("content", "memory_type").alias("concepts")))


# queries in words, made of the conversations' first words and fixed phrases
_PHRASES = ("what do i like about python", "tell me about my goals", "i ran the deploy yesterday", "show everything i know how to do", "how does ai believe")
_ASKED = {"asked": f"SELECT conv_id, turn, ({_q(_PHRASES)})[CAST((conv_id + turn) % 5 AS INTEGER) + 1] || ' ' || lower(coalesce(text, '')) AS text FROM conversations WHERE role = 'user'"}


def _asked(v):
    phrase = F.get(F.array(*map(F.lit, _PHRASES)), ((F.col("conv_id") + F.col("turn")) % 5).cast("int"))
    return v.table("conversations").where("role = 'user'").select("conv_id", "turn", F.concat(phrase, F.lit(" "), F.lower(F.coalesce("text", F.lit("")))).alias("text"))


def _rx(p: str) -> str:
    return f"regexp_matches(text, '{p}')"


@query("c13_query_intents", "SELECT conv_id, turn, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_rx(a)} OR {_rx(b)} THEN '{k}' END" for k, (a, b) in T.INTENTS.items()) + "], lambda x: x IS NOT NULL), ',') AS intents, array_to_string(list_slice(flatten([" + ", ".join(f"CASE WHEN contains(text, '{k}') THEN {_q(ws)} ELSE [] END" for k, ws in T.EXPANSIONS.items()) + "]), 1, 5), ',') AS expansions, CASE WHEN " + " OR ".join([_rx(p) for p in T.INTENTS["recent"]] + [f"contains(text, '{w}')" for w in T.RECENT_WORDS]) + " THEN 'recent' WHEN " + " OR ".join(f"contains(text, '{w}')" for w in T.DEEP_WORDS) + " THEN 'deep' WHEN " + " OR ".join(_rx(p) for ps in T.INTENTS.values() for p in ps) + " THEN 'contextual' END AS suggested_mode FROM asked", _ASKED)
def c13(v):
    return _asked(v).select("conv_id", "turn", F.array_join(T.detect_intents("text"), ",").alias("intents"), F.array_join(T.expand_query("text"), ",").alias("expansions"), T.suggest_mode("text").alias("suggested_mode"))


@query("c14_query_concepts", "SELECT conv_id, turn, array_to_string(list_slice(list_filter([" + ", ".join(f"CASE WHEN contains(text, '{w}') THEN '{c}' END" for w, c in T.QUERY_WORDS) + "], lambda x: x IS NOT NULL), 1, 5), ',') AS concepts, array_to_string(list_slice(list_filter([" + ", ".join(f"CASE WHEN contains(text, '{w}') THEN '{w}' END" for w in T.KNOWN_TAGS) + "], lambda x: x IS NOT NULL), 1, 10), ',') AS tags FROM asked", _ASKED)
def c14(v):
    return _asked(v).select("conv_id", "turn", F.array_join(T.query_concepts("text"), ",").alias("concepts"), F.array_join(T.query_tags("text"), ",").alias("tags"))


@query("c15_chunk_text")
def c15(v):
    """Chunks of whole texts; the test holds them to the rules and to reconstruction."""
    return A.chunk_text(v.memories, "memory_id", "content").select("memory_id", "chunk_id", "position", F.char_length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@query("c16_reconstruct", "SELECT memory_id, md5(content) AS digest FROM memories")
def c16(v):
    return A.reconstruct(A.chunk_text(v.memories, "memory_id", "content"), "memory_id").select("memory_id", F.md5("text").alias("digest"))


@query("c18_precedent_shape", "SELECT src, dst, concat_ws('-', coalesce(nullif(lower(trim(edge_type)), ''), 'unknown'), 'unknown', CASE WHEN strength > 50 THEN 'keep' ELSE 'unknown' END) AS shape FROM edges")
def c18(v):
    return v.edges.select("src", "dst", T.precedent_shape("edge_type", F.lit("  "), F.when(F.col("strength") > 50, " KEEP").otherwise("")).alias("shape"))


@query("c19_dispute_kind", f"SELECT src, dst, strategy, CASE WHEN strategy IN ('{STRATEGIES[0]}', 'taste') THEN 'preference' ELSE 'factual' END AS kind FROM contradicts")
def c19(v):
    return v.contradicts.select("src", "dst", "strategy", T.dispute_kind("strategy").alias("kind"))


@query("c20_chain_set", "SELECT memory_id, 'a' || doc_id % 5 || ',b c' || CASE WHEN doc_id % 2 = 0 THEN ',d' ELSE '' END AS members FROM memories WHERE doc_id % 3 <> 0 UNION ALL SELECT memory_id, '' FROM memories WHERE doc_id % 3 = 0")
def c20(v):
    d = F.col("doc_id")
    text = F.concat(F.lit("It may hold via the chain A"), d % 5, F.lit(" -> B c"), F.when(d % 2 == 0, " -> D ").otherwise(""), F.lit(". Found by a walk."))
    return v.memories.select("memory_id", F.array_join(T.chain_set(F.when(d % 3 == 0, "no chain here").otherwise(text)), ",").alias("members"))


@query("c21_fallback_score", """SELECT memory_id, round(least(greatest(0.7 * (len(list_filter(['the', 'tion', 'ont', 'reason'], lambda w: contains(lower(content), w))) / 4.0) + 0.3 * (importance / 100.0 + certainty / 100.0) / 2, 0), 1), 6) AS score FROM (SELECT memory_id, content, least(importance, 100) AS importance, least(certainty, 100) AS certainty FROM memories)""")
def c21(v):
    return v.memories.select("memory_id", F.round(T.fallback_score(F.lit("The TION; is of ont-reason"), "content", "importance", "certainty"), 6).alias("score"))


@query("c23_truncate_chars", "SELECT memory_id, CASE WHEN length(content) > 110 THEN left(content, 110) || '...' ELSE content END AS snippet FROM memories")
def c23(v):
    return v.memories.select("memory_id", T.truncate_chars("content", 110, "...").alias("snippet"))


@query("c24_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS raw, round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 5) AS score FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1")
def c24(v):
    b = v.vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.vectors.join(b, "vec_id").select("vec_id", F.round(T.cosine("embedding", "other"), 5).alias("raw"), F.round(T.cosine_score("embedding", "other"), 5).alias("score"))


@query("c25_edge_strength", "SELECT src, dst, edge_type, round(CASE WHEN strength % 3 = 0 THEN 1.0 ELSE least(greatest(strength / 100.0, 0), 1) END, 6) AS weight FROM edges")
def c25(v):
    given = F.when(F.col("strength") % 3 != 0, F.col("strength"))
    return v.edges.select("src", "dst", "edge_type", F.round(T.edge_strength(F.lit(None).cast("long"), given), 6).alias("weight"))


@query("c26_edge_type", "SELECT src, dst, CASE edge_type WHEN 'SUPPORTS' THEN 'IS_A' WHEN 'CONTRADICTS' THEN 'RELATES_TO' ELSE edge_type END AS kind, edge_type IN ('IMPLIES', 'BECAUSE') AS causal FROM edges")
def c26(v):
    said = F.when(F.col("edge_type") == "SUPPORTS", " is a ").when(F.col("edge_type") == "CONTRADICTS", "argues with").otherwise(F.lower("edge_type"))
    return v.edges.withColumn("kind", T.edge_type(said)).select("src", "dst", "kind", T.is_causal("kind").alias("causal"))


@query("c27_context_type", "SELECT memory_id, CASE WHEN contains(context_tags, ':') THEN split_part(context_tags, ':', 1) ELSE 'general' END AS kind FROM memories")
def c27(v):
    return v.memories.select("memory_id", T.context_type("context_tags").alias("kind"))
