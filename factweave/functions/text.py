"""Column functions on texts, hashes and scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: words that keyword search leaves out
STOPWORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "be", "been", "being")
# fixed values: fillers that do not make a subject
FILLERS = ("this", "that", "with", "from", "have", "been", "were", "will", "which", "would", "should", "there")
# fixed values: markers of contrast; the first five split a text
CONTRASTS = (" but ", " however ", " although ", " whereas ", " on the other hand ", " in contrast ", " conversely ", " nevertheless ")
# fixed values: connective, and whether the cause stands second
CAUSAL = ((" because ", True), (" therefore ", False), (" потому что ", True), (" так как ", True), (" из-за ", True), (" поэтому ", False))
# fixed values: connective and edge, first clause to second
STRUCTURAL = (
    (" is part of ", "PART_OF"), (" is a component of ", "PART_OF"), (" is a module of ", "PART_OF"), (" является частью ", "PART_OF"), (" входит в состав ", "PART_OF"),
    (" is a kind of ", "IS_A"), (" is a type of ", "IS_A"), (" is a variety of ", "IS_A"), (" это разновидность ", "IS_A"), (" это вид ", "IS_A"),
)
# fixed values: keywords of concepts in stored texts
CLASSIFIER_WORDS = {
    "Preference": ("love", "like", "prefer", "enjoy", "favorite", "hate", "dislike"),
    "Skill": ("can", "know how", "able to", "expert", "proficient", "skilled"),
    "Fact": ("is", "are", "was", "were", "has", "have"),
    "Goal": ("want", "plan", "goal", "aim", "intend", "wish"),
    "Opinion": ("think", "believe", "feel", "opinion", "view"),
    "Experience": ("did", "went", "saw", "experienced", "happened"),
    "Achievement": ("completed", "finished", "achieved", "accomplished", "built"),
}
# fixed values: keywords that map new texts to concepts
MAPPER_WORDS = {
    "Preference": ("like", "love", "prefer", "favorite", "enjoy", "hate", "dislike"),
    "Skill": ("can", "able to", "skilled at", "expert in", "know how", "proficient"),
    "Goal": ("want", "goal", "aim", "plan", "wish", "hope", "intend"),
    "Opinion": ("think", "believe", "feel", "opinion", "view", "consider"),
    "Fact": ("fact", "is", "has", "knows", "information", "data"),
    "Action": ("did", "does", "doing", "performed", "executed", "ran"),
    "Experience": ("experienced", "went through", "encounter", "witnessed"),
    "Achievement": ("completed", "finished", "achieved", "success", "accomplished"),
}
# fixed values: keywords that put a concept to a query
QUERY_WORDS = (
    ("preference", "Preference"), ("like", "Preference"), ("love", "Preference"), ("enjoy", "Preference"), ("hate", "Preference"), ("dislike", "Preference"),
    ("skill", "Skill"), ("know", "Skill"), ("learn", "Skill"), ("expert", "Skill"), ("master", "Skill"),
    ("goal", "Goal"), ("want", "Goal"), ("plan", "Goal"), ("aim", "Goal"), ("objective", "Goal"),
    ("fact", "Fact"), ("remember", "Fact"), ("true", "Fact"), ("false", "Fact"),
    ("opinion", "Opinion"), ("think", "Opinion"), ("believe", "Opinion"), ("feel", "Opinion"),
    ("experience", "Experience"), ("did", "Experience"), ("happened", "Experience"),
    ("achievement", "Achievement"), ("completed", "Achievement"), ("finished", "Achievement"), ("succeeded", "Achievement"),
)
# fixed values: tags that a query may name (one product name left out)
KNOWN_TAGS = (
    "python fastapi rust javascript typescript react django flask nodejs docker kubernetes aws gcp postgresql mongodb redis "
    "ollama openai async api backend frontend database graph work personal project home travel health finance learning "
    "career family ai ml memory llm embedding vector search programming coding development architecture"
).split()
# fixed values: patterns of intents
INTENTS = {
    "preference": (r"\b(like|love|prefer|favorite|enjoy|fond of|into)\b", r"\b(what do i like|what are my favorites|my preferences)\b"),
    "skill": (r"\b(can i|able to|know how|capable|proficient|skilled|expert)\b", r"\b(what (can|do) i (do|know)|my (skills|abilities|expertise))\b"),
    "goal": (r"\b(want to|goal|plan|aim|intend|aspire|wish)\b", r"\b(my (goals|plans|objectives|ambitions))\b"),
    "fact": (r"\b(what is|tell me about|explain|describe|information about)\b", r"\b(how does|how do|what does)\b"),
    "opinion": (r"\b(think|believe|opinion|feel about|view on)\b", r"\b(what do i think|my (opinion|view|thoughts))\b"),
    "experience": (r"\b(have i|was i|when did|remember when)\b", r"\b(my (experience|history) with)\b"),
    "achievement": (r"\b(achieved|accomplished|completed|finished|won|built|earned)\b", r"\b(my (achievements|accomplishments|milestones))\b"),
    "action": (r"\b(did i|i did|i ran|i executed|i performed|i deployed)\b", r"\b(what did i (do|run|execute|perform|deploy))\b"),
    "recent": (r"\b(today|yesterday|recently|lately|just now|this week)\b", r"\b(what (did|have) i (do|done)|current|latest)\b"),
}
# fixed values: terms and what they expand to
EXPANSIONS = {
    "like": ("love", "enjoy", "prefer", "fond of", "appreciate"), "love": ("like", "adore", "enjoy", "passionate about"),
    "prefer": ("like", "favor", "choose", "opt for"), "can": ("able to", "capable of", "know how to", "proficient in"),
    "skill": ("ability", "expertise", "competence", "proficiency"), "want": ("wish", "desire", "aim", "plan", "intend"),
    "goal": ("objective", "target", "aim", "ambition", "plan"), "python": ("programming", "coding", "development", "backend"),
    "ai": ("artificial intelligence", "machine learning", "ml", "llm"), "today": ("now", "current", "recent", "latest"), "recently": ("lately", "just", "new", "fresh"),
}
# fixed values: words that ask for the recent and for the deep mode
RECENT_WORDS = ("today", "yesterday", "recently", "lately", "just now", "this week")
DEEP_WORDS = ("all", "everything", "complete", "full", "entire")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeezed(text: Column | str) -> Column:
    """White space of any kind as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def content_key(text: Column | str, memory_type: Column | str, scope: Column | str | None = None) -> Column:
    """The fingerprint of a fact: scope, type and text, parted by a zero byte."""
    parts = [F.lower(_c(memory_type)), F.char(F.lit(0)), F.lower(squeezed(text))]
    if scope is not None:
        parts = [_c(scope), F.char(F.lit(0)), *parts]
    return F.sha2(F.concat(*parts), 256)


def bm25_tokens(text: Column | str) -> Column:
    """Words in lower case, without stop words and such of two bytes or less."""
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"(?U)(\b\w+\b)"), 1)
    return F.filter(words, lambda w: (F.octet_length(w) > 2) & ~w.isin(*STOPWORDS))


def subject_tokens(text: Column | str) -> Column:
    words = F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (F.char_length(w) >= 4) & ~w.isin(*FILLERS))


def shares_subject(a: Column | str, b: Column | str) -> Column:
    """A common word of four characters or more; true where ``a`` has none."""
    own = subject_tokens(a)
    return (F.size(own) == 0) | F.arrays_overlap(own, subject_tokens(b))


def is_coherent(text: Column | str) -> Column:
    """C4: false for several long sentences with a contrast and different first words."""
    t = _c(text)
    low = F.lower(t)
    long_ones = F.size(F.filter(F.split(t, r"[.!?]"), lambda s: F.octet_length(F.btrim(s)) > 10))
    contrast = F.lit(False)
    for marker in CONTRASTS:
        contrast = contrast | low.contains(marker)
    parts = F.filter(F.split(low, r"[.;,]"), lambda s: F.octet_length(F.btrim(s)) > 5)
    firsts = F.array_distinct(F.transform(parts, lambda s: F.get(F.split(F.btrim(s), r"\s+"), F.lit(0))))
    return ~((long_ones > 1) & contrast & (F.size(firsts) > 1))


def split_at(text: Column | str, markers: tuple[str, ...], usable) -> Column:
    """The parts before and after the first marker in the list's order whose parts are ``usable``; null for none."""
    t = _c(text)
    low, out = F.lower(t), F.lit(None)
    for m in reversed(markers):
        at = F.locate(m, low)
        first = F.btrim(F.substring(t, F.lit(1), at - 1))
        second = F.btrim(F.substring(t, at + len(m), F.length(t)))
        out = F.when((at > 0) & usable(first, second), F.array(first, second)).otherwise(out)
    return out


def split_incoherent(text: Column | str) -> Column:
    """Two parts of over ten bytes, or the text alone."""
    parts = split_at(text, CONTRASTS[:5], lambda a, b: (F.octet_length(a) > 10) & (F.octet_length(b) > 10))
    return F.coalesce(parts, F.array(_c(text)))


def _first_marker(text: Column | str, table) -> Column:
    """Place of the first marker of the list that the text holds, as (nth, at)."""
    low, out = F.lower(_c(text)), F.lit(None).cast("struct<nth: int, at: int>")
    for k in range(len(table) - 1, -1, -1):
        at = F.locate(table[k][0], low)
        out = F.when(at > 0, F.struct(F.lit(k).alias("nth"), at.alias("at"))).otherwise(out)
    return out


def _sides(text: Column | str, table) -> tuple[Column, Column, Column]:
    t, hit = _c(text), _first_marker(text, table)
    size = F.get(F.array(*(F.lit(len(m)) for m, _ in table)), hit["nth"])
    return hit["nth"], F.btrim(F.substring(t, F.lit(1), hit["at"] - 1)), F.btrim(F.substring(t, hit["at"] + size, F.length(t)))


def split_causal(text: Column | str) -> Column:
    """Struct of cause and effect; null without a connective or with an empty side."""
    nth, first, second = _sides(text, CAUSAL)
    swapped = F.get(F.array(*(F.lit(x) for _, x in CAUSAL)), nth)
    both = F.when(swapped, F.struct(second.alias("cause"), first.alias("effect"))).otherwise(F.struct(first.alias("cause"), second.alias("effect")))
    return F.when((first != "") & (second != ""), both)


def split_structural(text: Column | str) -> Column:
    """Struct of edge type and both ends; commas and semicolons at the end of the first go."""
    nth, first, second = _sides(text, STRUCTURAL)
    first = F.regexp_replace(first, r"[,;]+$", "")
    edge = F.get(F.array(*(F.lit(x) for _, x in STRUCTURAL)), nth)
    return F.when((first != "") & (second != ""), F.struct(edge.alias("edge_type"), first.alias("from_text"), second.alias("to_text")))


def keyword_scores(text: Column | str, table: dict[str, tuple[str, ...]]) -> Column:
    """Array of concept and share of its keywords that the text holds, highest first, then by name."""
    # the text in lower case is bound as the element of an array, so that it is made once and not for each keyword
    rows = lambda low: F.array(*(F.struct((-sum((low.contains(w).cast("int") for w in words), F.lit(0)) / F.lit(float(len(words)))).alias("minus"), F.lit(name).alias("concept")) for name, words in table.items()))
    return F.transform(F.filter(F.array_sort(F.get(F.transform(F.array(F.lower(_c(text))), rows), F.lit(0))), lambda r: r["minus"] < 0), lambda r: F.struct(r["concept"].alias("concept"), (-r["minus"]).alias("score")))


def classify_concepts(text: Column | str, min_conf: float = 0.0) -> Column:
    """C10."""
    return F.filter(keyword_scores(text, CLASSIFIER_WORDS), lambda r: r["score"] >= min_conf)


def map_to_concepts(text: Column | str, memory_type: Column | str, top_k: int = 3) -> Column:
    """C11: the best concepts, and the row's own type at 0.9 if it is not among them."""
    best = F.slice(keyword_scores(text, MAPPER_WORDS), 1, top_k)
    own = F.initcap(_c(memory_type))
    whole = lambda b: F.when(F.exists(b, lambda r: r["concept"] == own), b).otherwise(F.concat(b, F.array(F.struct(own.alias("concept"), F.lit(0.9).alias("score")))))
    return F.get(F.transform(F.array(best), whole), F.lit(0))


def detect_intents(query: Column | str) -> Column:
    """Names of intents with a pattern that the query holds."""
    q = _c(query)
    return F.array_compact(F.array(*(F.when(q.rlike(a) | q.rlike(b), F.lit(name)) for name, (a, b) in INTENTS.items())))


def expand_query(query: Column | str, at_most: int = 5) -> Column:
    """What the query's terms expand to, in the table's order, cut to ``at_most``."""
    low = F.lower(_c(query))
    lists = [F.when(low.contains(term), F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")) for term, words in EXPANSIONS.items()]
    return F.slice(F.flatten(F.array(*lists)), 1, at_most)


def suggest_mode(query: Column | str) -> Column:
    """Recent, deep, contextual, or null."""
    q = _c(query)
    low, intents = F.lower(q), detect_intents(q)
    any_of = lambda words: F.coalesce(*[F.when(low.contains(w), True) for w in words], F.lit(False))
    return F.when(F.array_contains(intents, "recent") | any_of(RECENT_WORDS), "recent").when(any_of(DEEP_WORDS), "deep").when(F.size(intents) > 0, "contextual")


def query_concepts(query: Column | str, at_most: int = 5) -> Column:
    """C14: the concept of each keyword found, repeats included, the first five."""
    low = F.lower(_c(query))
    return F.slice(F.array_compact(F.array(*(F.when(low.contains(w), F.lit(c)) for w, c in QUERY_WORDS))), 1, at_most)


def query_tags(query: Column | str, at_most: int = 10) -> Column:
    """C14: known tags found."""
    low = F.lower(_c(query))
    return F.slice(F.array_compact(F.array(*(F.when(low.contains(t), F.lit(t)) for t in KNOWN_TAGS))), 1, at_most)


def precedent_shape(new_type: Column | str, old_type: Column | str, verdict: Column | str) -> Column:
    """The three, trimmed and in lower case, empty as unknown."""
    clean = lambda x: F.coalesce(F.nullif(F.lower(F.btrim(_c(x))), F.lit("")), F.lit("unknown"))
    return F.concat_ws("-", clean(new_type), clean(old_type), clean(verdict))


def dispute_kind(strategy: Column | str) -> Column:
    """C19."""
    return F.when(F.lower(_c(strategy)).rlike("preference|opinion|taste|style|subjective"), "preference").otherwise("factual")


def chain_set(text: Column | str) -> Column:
    """C20: the names in "via the chain A -> B -> C. Found by"; empty without one."""
    inner = F.regexp_extract(_c(text), r"(?s)via the chain (.*?)\. Found by", 1)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, " -> "), lambda x: F.lower(F.btrim(x))))


def fallback_score(query: Column | str, text: Column | str, importance: Column | str, certainty: Column | str) -> Column:
    """0.7 times the share of query words that the text holds, 0.3 times mean confidence."""
    words = F.filter(F.split(F.lower(_c(query)), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) > 2)
    low = F.lower(_c(text))
    share = F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: low.contains(w))), F.size(words)), F.lit(0.0))
    part = lambda x: F.least(F.greatest(_c(x), F.lit(0)), F.lit(100)) / 100.0
    return F.least(F.greatest(0.7 * share + 0.3 * (part(importance) + part(certainty)) / 2, F.lit(0.0)), F.lit(1.0))


def truncate_chars(text: Column | str, n: int, mark: str = "") -> Column:
    """The first n characters; the mark where something is cut off."""
    t = _c(text)
    return F.when(F.char_length(t) > n, F.concat(F.substring(t, 1, n), F.lit(mark))).otherwise(t)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Raw cosine; 0 for different lengths or a zero vector."""
    x, y = _c(a), _c(b)
    total = lambda z: F.aggregate(z, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    norm = F.sqrt(total(F.transform(x, lambda p: p.cast("double") * p.cast("double")))) * F.sqrt(total(F.transform(y, lambda p: p.cast("double") * p.cast("double"))))
    return F.when(F.size(x) != F.size(y), 0.0).otherwise(F.coalesce(F.try_divide(dot, norm), F.lit(0.0)))


def cosine_score(a: Column | str, b: Column | str) -> Column:
    """(cosine + 1) / 2 between 0 and 1; 0 for different lengths or a zero vector."""
    x, y = _c(a), _c(b)
    zero = lambda z: ~F.exists(z, lambda p: p != 0)
    return F.when((F.size(x) != F.size(y)) | zero(x) | zero(y), 0.0).otherwise(sanitize_unit((cosine(x, y) + 1) / 2))


def sanitize_unit(x: Column | str) -> Column:
    """NaN and infinities as 0, then between 0 and 1."""
    v = _c(x).cast("double")
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(bad, 0.0).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def edge_strength(strength: Column | str, probability: Column | str | None = None) -> Column:
    """The first of both that is given, as a share; 1 for none."""
    given = F.coalesce(_c(strength), _c(probability)) if probability is not None else _c(strength)
    # least and greatest would pass over a null
    return F.when(given.isNull(), 1.0).otherwise(F.least(F.greatest(given / 100.0, F.lit(0.0)), F.lit(1.0)))


def edge_type(token: Column | str) -> Column:
    """The token in upper case with underscores; unknown ones relate."""
    clean = F.replace(F.upper(F.btrim(_c(token))), F.lit(" "), F.lit("_"))
    return F.when(clean.isin("IMPLIES", "BECAUSE", "CONTRADICTS", "SUPPORTS", "RELATES_TO", "PART_OF", "IS_A"), clean).otherwise("RELATES_TO")


def is_causal(edge: Column | str) -> Column:
    return _c(edge).isin("IMPLIES", "BECAUSE")


def context_type(tag: Column | str) -> Column:
    """What stands before a colon, or general."""
    t = _c(tag)
    return F.when(t.contains(":"), F.substring_index(t, ":", 1)).otherwise("general")
