"""DuckDB SQL of the registered queries. RE2 has no lookaround, so word edges are captured and put back."""

from __future__ import annotations

import unicodedata

from wordweft.functions import prompts, spoken, unicode
from wordweft.operators import labels, restorer
from wordweft.sources import tables


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_S = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
_WORD = r"[\p{L}\p{N}_]"
_LEX = r"[\p{L}\p{Nl}\p{No}]+"
# What masking looks for, with plain word edges: the tables are ASCII around them.
_PII = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "SSN": r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,19}\b",
    "PHONE": r"\b(?:\+?\d{1,3}[\s-]?)?(?:\(?\d{2,4}\)?[\s-]?)?\d{3,4}[\s-]?\d{3,4}\b",
}
_URL = r"https?://(www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b([-a-zA-Z0-9()@:%_\+.~#?&/=]*)"


def _masked(c: str, upto: int = 4) -> str:
    for name, p in list(_PII.items())[:upto]:
        c = f"regexp_replace({c}, {_lit(p)}, '[{name}]', 'g')"
    return c


def _cleaned(c: str, urls: bool = True) -> str:
    c = f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"
    if urls:
        c = f"regexp_replace({c}, {_lit(_URL)}, '', 'g')"
    return f"trim(regexp_replace({c}, {_lit(_S + '+')}, ' ', 'g'))"


def _keys_replaced(c: str, table: dict[str, str]) -> str:
    """Each key twice, longest first, with its neighbours captured: no value holds another key at a word edge."""
    for k in sorted(table, key=lambda x: (-len(x), x)):
        quoted = "".join("\\" + ch if not ch.isalnum() else ch for ch in k)
        for _ in range(2):
            c = f"regexp_replace({c}, {_lit('(?i)(^|[^\\p{L}\\p{N}_])' + quoted + '($|[^\\p{L}\\p{N}_])')}, {_lit('\\1' + table[k] + '\\2')}, 'g')"
    return c


def _digits(c: str, lang: str) -> str:
    for d, w in enumerate(spoken.DIGITS[lang]):
        c = f"replace({c}, '{d}', {_lit(f' {w} ')})"
    return f"trim(regexp_replace({c}, {_lit(_S + '+')}, ' ', 'g'))"


def _stripped(c: str) -> str:
    marked, plain = unicode._latin_pairs()
    return f"translate({c}, {_lit(marked)}, {_lit(plain)})"


def _case(pairs: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in pairs.items()) + " END"


_TOKENS = rf"[\p{{L}}\p{{N}}_\x{{300}}-\x{{36f}}]+|[^\p{{L}}\p{{N}}_\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}\x{{300}}-\x{{36f}}]|{_S}+"
_CODES = "(VALUES (0,'yo'),(1,'YOR'),(2,' ig '),(3,'pt-BR'),(4,'pt_BR'),(5,'arb'),(6,'ar'),(7,'ara_nocase'),(8,'<yor>'),(9,'<es>'),(10,'de'),(11,'auto'),(12,'xx'),(13,'fr-CA'),(14,'vi'),(15,NULL)) v(i, code)"
_TAG = _case({**{t: t for t in prompts.TAGS}, **prompts.RESTORED}, "replace(regexp_replace(lower(trim(code)), '^[<>]+|[<>]+$', '', 'g'), '_', '-')")
_KNOWN = {**{v: v for v in prompts.RESTORED.values()}, **prompts.RESTORED, "arb": "ara"}
_FIRST = "split_part(replace(lower(trim(code)), '-', '_'), '_', 1)"

_FEATURES = rf"""
words AS (SELECT doc_id, lang, regexp_extract_all(lower(trim(text)), '{_WORD}+') AS w FROM documents),
terms AS (
  SELECT doc_id, lang, unnest(w) AS term FROM words
  UNION ALL SELECT doc_id, lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words WHERE len(w) > 1)"""
_LID = f"""WITH {_FEATURES},
meta AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang) - 1 AS idx, sum(count(*)) OVER () AS total FROM documents GROUP BY lang),
own AS (SELECT term, lang, count(DISTINCT doc_id) AS df FROM terms GROUP BY term, lang),
known AS (SELECT term, sum(df) AS df FROM own GROUP BY term HAVING sum(df) >= 2),
share AS (SELECT k.term, k.df, m.lang, m.total, ln((coalesce(o.df, 0) + 1) / (m.n + 2)) AS s FROM known k CROSS JOIN meta m LEFT JOIN own o ON o.term = k.term AND o.lang = m.lang),
model AS (SELECT term, lang AS class, ln((1 + total) / (1 + df)) + 1 AS idf, s - avg(s) OVER (PARTITION BY term) AS weight FROM share),
tf AS (SELECT doc_id, term, count(*) AS n FROM terms GROUP BY doc_id, term),
x AS (SELECT tf.doc_id, model.class, (1 + ln(tf.n)) * model.idf AS x, model.weight FROM tf JOIN model USING (term)),
sums AS (SELECT doc_id, class, sum(x * weight) AS dot, sqrt(sum(x * x)) AS norm FROM x GROUP BY doc_id, class),
scores AS (
  SELECT d.doc_id, m.lang AS class, m.idx,
    CASE WHEN coalesce(trim(regexp_replace(d.text, '{_S}+', ' ', 'g')), '') = '' THEN 0.0 ELSE ln(m.n / m.total) + coalesce(s.dot / s.norm, 0.0) END AS score
  FROM documents d CROSS JOIN meta m LEFT JOIN sums s ON s.doc_id = d.doc_id AND s.class = m.lang),
proba AS (SELECT doc_id, class, idx, exp(score - max(score) OVER w) / sum(exp(score)) OVER w * exp(max(score) OVER w) AS proba FROM scores WINDOW w AS (PARTITION BY doc_id)),
best AS (SELECT doc_id, class AS lang FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) = 1),
candidates AS (SELECT doc_id, class AS label, round(proba, 9) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY round(proba, 9) DESC, class) AS rank FROM proba)"""
_LEXICON = f"""WITH seen AS (SELECT lang, unnest(regexp_extract_all(text, {_lit(_LEX)})) AS variant FROM documents),
counts AS (SELECT lang, variant, count(*) AS cnt FROM seen GROUP BY lang, variant),
lexicon AS (SELECT lang, lower({_stripped("variant")}) AS key, variant, cnt FROM counts
  QUALIFY row_number() OVER (PARTITION BY lang, lower({_stripped("variant")}) ORDER BY cnt DESC, variant) <= 8 AND cnt >= 3)"""
_BY = "coalesce(lang, 'und')"
_KNN = f"""WITH toks AS (SELECT {_BY} AS lang, unnest(regexp_extract_all(text, {_lit(_TOKENS)})) AS token FROM documents),
w AS (SELECT lang, lower(token) AS word, lower({_stripped("token")}) AS plain FROM toks WHERE regexp_matches(token, '^[\\p{{L}}\\p{{N}}_]')),
v0 AS (SELECT lang, word, plain, count(*) AS times FROM w WHERE length(word) = length(plain) GROUP BY ALL),
chars AS (SELECT lang, times, substr('__' || plain || '__', k::INT, 5) AS ctx, substr(word, k::INT, 1) AS out FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM v0)),
every AS (SELECT lang, 5 AS width, ctx, out, times FROM chars UNION ALL SELECT lang, 3, substr(ctx, 2, 3), out, times FROM chars UNION ALL SELECT lang, 1, substr(ctx, 3, 1), out, times FROM chars),
counted AS (SELECT lang, width, ctx, out, sum(times) AS n FROM every GROUP BY lang, width, ctx, out),
model AS (SELECT lang, width, ctx, out FROM counted QUALIFY row_number() OVER (PARTITION BY lang, width, ctx ORDER BY n DESC, out) = 1)"""


def _restored(docs: str, targets: str, model: str, by: str) -> str:
    """doc_id, restored of the texts of docs (doc_id, lang, text); model and by: what a text's words look at."""
    cased = "CASE WHEN r.word IS NULL THEN token WHEN upper(token) = token AND lower(token) <> token THEN upper(restored) WHEN upper(token[1]) = token[1] AND lower(token[1]) <> token[1] THEN upper(restored[1]) || lower(restored[2:]) ELSE restored END"
    joins = " ".join(f"LEFT JOIN {model} m{w} ON m{w}.width = {w} AND m{w}.ctx = {k}{by.format(w=w)}" for w, k in ((5, "ch.ctx"), (3, "substr(ch.ctx, 2, 3)"), (1, "ch.c")))
    return f"""t AS (SELECT doc_id, lang, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS token FROM (SELECT doc_id, lang, regexp_extract_all(text, {_lit(_TOKENS)}) AS l FROM {docs})),
v AS (SELECT DISTINCT lang, lower(token) AS word FROM t WHERE regexp_matches(token, '^[\\p{{L}}\\p{{N}}_]')),
ch AS (SELECT lang, word, k, substr('__' || word || '__', k::INT, 5) AS ctx, substr(word, k::INT, 1) AS c FROM (SELECT lang, word, unnest(range(1, length(word) + 1)) AS k FROM v)),
r AS (SELECT ch.lang, ch.word, string_agg(CASE WHEN contains({targets}, c) THEN coalesce(m5.out, m3.out, m1.out, c) ELSE c END, '' ORDER BY k) AS restored FROM ch {joins} GROUP BY ch.lang, ch.word),
done AS (SELECT t.doc_id, string_agg({cased}, '' ORDER BY pos) AS restored FROM t LEFT JOIN r ON r.lang = t.lang AND r.word = lower(token) GROUP BY t.doc_id)"""


def _recased(c: str) -> str:
    """Every word lower-cased and given its own case again: all upper, capitalised, or lower."""
    one = "CASE WHEN NOT regexp_matches(t, '^[\\p{L}\\p{N}_]') THEN t WHEN upper(t) = t AND lower(t) <> t THEN t WHEN upper(t[1]) = t[1] AND lower(t[1]) <> t[1] THEN upper(t[1]) || lower(t[2:]) ELSE lower(t) END"
    return f"array_to_string(list_transform(regexp_extract_all({c}, {_lit(_TOKENS)}), lambda t: {one}), '')"


_MESSAGE = prompts.QUESTION_PROMPT.format(n=4, language="Yoruba", slots=", ".join(['"..."'] * 4))
_WINDOWS = """WITH d AS (SELECT doc_id, length(text) AS n FROM documents),
s AS (SELECT doc_id, n, CASE WHEN n <= 384 THEN [0] ELSE list_distinct(list_append(range(0, n - 383, 256), n - 384)) END AS st FROM d),
o AS (SELECT doc_id, n, list_sort(st) AS st FROM s),
e AS (SELECT doc_id, n, st, unnest(range(1, len(st) + 1)) AS k FROM o)
SELECT doc_id, k - 1 AS i, st[k] AS start, CASE WHEN n <= 384 THEN n ELSE st[k] + 384 END AS "end",
  CASE WHEN k = 1 THEN 0 ELSE (st[k] + st[k - 1] + 384) // 2 END AS accept_start,
  CASE WHEN k = len(st) THEN n ELSE (st[k + 1] + st[k] + 384) // 2 END AS accept_end FROM e"""

SQL: dict[str, str] = {
    "mask_pii": f"SELECT doc_id, {_masked('text')} AS masked FROM documents",
    "pii_findings": "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all({_masked('text', i)}, {_lit(p)}))::BIGINT AS {n.lower()}" for i, (n, p) in enumerate(_PII.items())) + " FROM documents",
    "clean_text": f"SELECT page_id, {_cleaned('html')} AS cleaned FROM pages",
    "clean_text_keep_urls": f"SELECT page_id, {_cleaned("url || ' ' || html", False)} AS cleaned, {_cleaned('url')} AS url_left FROM pages",
    "tts_digits": f"SELECT doc_id, {_digits('text', 'yo')} AS spoken FROM documents",
    "tts_abbreviations": f"SELECT doc_id, {_keys_replaced('text', spoken.ABBREVIATIONS['ig'])} AS spoken FROM documents",
    "tts_normalize": f"SELECT doc_id, {_digits(_keys_replaced('text', spoken.ABBREVIATIONS['ig']), 'ig')} AS spoken FROM documents",
    "stopwords_table": "SELECT lang, count(*) AS n, min(word) AS first_word FROM (VALUES " + ", ".join(f"({_lit(lang)}, {_lit(w)})" for lang in spoken.STOPWORDS for w in spoken.stopwords(lang)) + ") v(lang, word) GROUP BY lang",
    "stopword_filter": "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \\n]'), lambda w: w <> '' AND NOT list_contains([" + ", ".join(_lit(w) for w in spoken.stopwords("pcm")) + "], lower(w))), ' ') AS kept FROM documents",
    "split_sentences": f"""WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, {_lit(f'^{_S}+|{_S}+$')}, '', 'g'), {_lit(f'([.!?]){_S}+')}, '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, {_lit('[^' + _S[1:])})) AS s FROM documents)
SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM p""",
    "format_currency": "SELECT o_orderkey, '₦' || format('{:,.2f}', o_totalprice) AS price, '$' || o_orderpriority AS no_number FROM orders",
    "steg_bits": "SELECT item_id, rpad(array_to_string(list_transform(string_split(s, ''), lambda c: lpad(bin(ascii(c)), 8, '0')), ''), 96, '0') AS bits, s AS back FROM (SELECT item_id, 'id-' || item_id AS s FROM benchmark)",
    "resolve_tag": f"SELECT i::BIGINT AS i, CASE WHEN code IS NULL THEN 'auto' ELSE {_TAG} END AS tag, CASE WHEN code IS NULL THEN 'auto' WHEN {_TAG} = 'ara' THEN 'ara-nocase' ELSE {_TAG} END AS tag_nocase FROM {_CODES}",
    "normalize_lang": f"SELECT i::BIGINT AS i, {_case(_KNOWN, _FIRST)} AS lang, {_case({k: v for k, v in _KNOWN.items() if v != 'ara'}, _FIRST)} AS lang_first_spec FROM {_CODES}",
    "build_hint": "SELECT n_nationkey, '[g: r=' || n_regionkey || ' | w=' || n_name || ']' AS hint FROM nation",
    "question_prompt": f"SELECT item_id, {_lit(prompts.QUESTION_SYSTEM)} AS system, {_lit(_MESSAGE)} || trim(text) AS user FROM benchmark",
    "question_parse": "SELECT n_nationkey, 'what is ' || n_name || '?|why?' AS whole, 'what is ' || n_name || '?' AS recovered FROM nation",
    "question_languages": "SELECT weak, count(*) AS n, max(name) AS last_name FROM (VALUES " + ", ".join(f"({_lit(name)}, {str(iso3 in prompts.WEAK_LANGUAGES).lower()})" for iso3, _, name in prompts.QUESTION_LANGUAGES) + ") v(name, weak) GROUP BY weak",
    "chat_messages": """WITH c AS (SELECT conv_id, list(role || ': ' || text ORDER BY turn) AS m, arg_min(role, turn) AS first FROM conversations GROUP BY conv_id)
SELECT conv_id, (len(m) + CASE WHEN first = 'system' THEN 0 ELSE 1 END)::BIGINT AS n, CASE WHEN first = 'system' THEN '' ELSE 'system: You are helpful.' || chr(10) END || array_to_string(m, chr(10)) AS chat FROM c""",
    "title_inputs": "SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "strip_diacritics": "SELECT doc_id, strip_accents(text) AS stripped FROM documents",
    "strip_all_marks": "SELECT doc_id, strip_accents(text) AS stripped, nfc_normalize(text) AS nfc FROM documents",
    "diacritic_density": f"SELECT doc_id, round(coalesce(CASE WHEN n = 0 THEN 0.0 ELSE m / n END, 0.0), 6) AS density FROM (SELECT doc_id, len(regexp_extract_all(text, '\\p{{L}}')) AS n, len(list_filter(string_split(text, ''), lambda c: c <> strip_accents(c))) AS m FROM documents)",
    "latin_share": "SELECT doc_id, coalesce(round(len(regexp_extract_all(text, '\\p{Latin}')) / nullif(len(regexp_extract_all(text, '\\p{L}')), 0), 6), 1.0) AS latin FROM documents",
    "grapheme_counts": "SELECT lang, g, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS g FROM documents) GROUP BY lang, g",
    "align_marks": "SELECT doc_id, text AS aligned FROM documents",
    "lid_features": f"WITH {_FEATURES} SELECT doc_id, term, count(*) AS n FROM terms GROUP BY doc_id, term",
    "lid_scores": f"{_LID} SELECT doc_id, class, round(score, 6) AS score FROM scores",
    "lid_predict": f"{_LID} SELECT doc_id, lang FROM best",
    "lid_proba": f"{_LID} SELECT doc_id, class, round(proba, 6) AS proba FROM proba",
    "lid_coverage": f"{_LID} SELECT doc_id, label FROM candidates WHERE rank = 1",
    "lid_traffic": f"""{_LID}, priors(label, bias) AS (VALUES ('de', 1.0), ('en', -1.0), ('es', 0.2)),
r AS (SELECT c.doc_id, c.label, c.rank, ln(greatest(c.p, 1e-12)) + coalesce(b.bias, 0) AS score FROM candidates c LEFT JOIN priors b USING (label))
SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rank) AS rank, round(exp(score) / sum(exp(score)) OVER (PARTITION BY doc_id), 5) AS proba FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, r.rank) <= 2""",
    "diac_tokenize": f"SELECT doc_id, count(*) AS tokens, count(*) FILTER (WHERE regexp_matches(token, '^[\\p{{L}}\\p{{N}}_]')) AS words FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_lit(_TOKENS)})) AS token FROM documents) GROUP BY doc_id",
    "knn_train": f"{_KNN} SELECT lang, width::BIGINT AS width, ctx, out FROM model",
    "viterbi_unigrams": f"WITH t AS (SELECT lang, lower(token) AS form, count(*) AS n FROM (SELECT {_BY} AS lang, unnest(regexp_extract_all(text, {_lit(_TOKENS)})) AS token FROM documents) WHERE regexp_matches(token, '^[\\p{{L}}\\p{{N}}_]') GROUP BY ALL) SELECT lang, form, round(ln(n / sum(n) OVER (PARTITION BY lang)), 6) AS logp FROM t",
    "plan_windows": _WINDOWS,
    "joint_decode": """WITH l AS (SELECT vec_id AS pos, label % 3 AS b, list_transform(embedding[1:3], lambda x: x::DOUBLE) AS s, list_transform(embedding[4:6], lambda x: x::DOUBLE) AS t FROM embeddings),
legal(b, shape_id, tone_id) AS (VALUES (0,0,0),(0,0,1),(0,0,2),(0,1,0),(0,1,1),(0,1,2),(1,0,0),(1,1,2),(2,0,0)),
p AS (SELECT pos, shape_id, tone_id, s[shape_id + 1] + t[tone_id + 1] AS v FROM l JOIN legal USING (b))
SELECT pos, shape_id::BIGINT AS shape_id, tone_id::BIGINT AS tone_id, round(exp(v) / sum(exp(v)) OVER (PARTITION BY pos), 6) AS confidence FROM p QUALIFY row_number() OVER (PARTITION BY pos ORDER BY v DESC, shape_id, tone_id) = 1""",
    "drop_case_endings": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag, l_linestatus) AS pos FROM lineitem)
SELECT l_orderkey AS doc_id, pos, CASE WHEN l_quantity > 10 AND NOT coalesce(lead(l_quantity > 10) OVER (PARTITION BY l_orderkey ORDER BY pos), false) AND l_linestatus <> 'F' THEN '' ELSE l_returnflag END AS tone FROM c""",
    "lexicon_build": f"{_LEXICON} SELECT lang, key, variant, cnt FROM lexicon",
    "lexicon_variants": f"{_LEXICON} SELECT c.lang, c.variant AS word, count(*) AS n, sum(l.cnt)::BIGINT AS cnt FROM counts c JOIN lexicon l ON l.lang = c.lang AND l.key = lower({_stripped('c.variant')}) WHERE NOT regexp_matches(c.variant, '^\\p{{Lu}}') OR regexp_matches(l.variant, '^\\p{{Lu}}') GROUP BY c.lang, c.variant",
    "lexicon_ambiguity": f"{_LEXICON}, k AS (SELECT lang, key, count(*) AS v, sum(cnt) AS t FROM lexicon GROUP BY lang, key) SELECT lang, count(*) AS forms, count(*) FILTER (WHERE v > 1) AS ambiguous, round(avg(CASE WHEN v > 1 THEN 1.0 ELSE 0.0 END), 4) AS ambiguous_share, round(sum(CASE WHEN v > 1 THEN t ELSE 0 END) / sum(t), 4) AS token_share FROM k GROUP BY lang",
    "oov_rate": f"""{_LEXICON}, w AS (SELECT doc_id, lang, word, count(*) AS n FROM (SELECT doc_id, lang, unnest(regexp_extract_all(text, {_lit(_LEX)})) AS word FROM documents) GROUP BY doc_id, lang, word),
k AS (SELECT DISTINCT lang, key FROM lexicon),
r AS (SELECT w.doc_id, sum(CASE WHEN k.key IS NOT NULL AND f.variant IS NULL THEN n ELSE 0 END) / sum(n) AS oov FROM w LEFT JOIN k ON k.lang = w.lang AND k.key = lower({_stripped('w.word')}) LEFT JOIN lexicon f ON f.lang = w.lang AND f.variant = w.word GROUP BY w.doc_id)
SELECT d.doc_id, round(coalesce(r.oov, 0.0), 6) AS oov FROM documents d LEFT JOIN r USING (doc_id)""",
    "cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "semantic_topk": "SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5",
    "rerank_rank": "WITH s AS (SELECT label::BIGINT AS query_id, vec_id AS id, round(exp(embedding[2]::DOUBLE - greatest(embedding[1], embedding[2])::DOUBLE) / (exp(embedding[1]::DOUBLE - greatest(embedding[1], embedding[2])::DOUBLE) + exp(embedding[2]::DOUBLE - greatest(embedding[1], embedding[2])::DOUBLE)), 6) AS score FROM embeddings) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s",
    "pipeline_flagship": f"{_LID}, m AS (SELECT doc_id, length({_masked(_cleaned('text'))})::BIGINT AS chars, round(CASE WHEN len(regexp_extract_all(text, '\\p{{L}}')) = 0 THEN 0.0 ELSE len(list_filter(string_split(text, ''), lambda c: c <> strip_accents(c))) / len(regexp_extract_all(text, '\\p{{L}}')) END, 6) AS density FROM documents) SELECT m.doc_id, best.lang AS detected, m.chars, m.density FROM m JOIN best USING (doc_id)",
}
# One informal spelling stands for a text that another table reads on, so the chain is built like the query's.
SQL["naija_normalize"] = f"SELECT doc_id, {_digits(_keys_replaced(_keys_replaced('text', spoken.INFORMAL), spoken.ABBREVIATIONS['pcm']), 'pcm')} AS spoken FROM documents"
_TARGETS = "CASE ch.lang WHEN 'es' THEN 'aeioun' WHEN 'fr' THEN 'aceiouy' WHEN 'de' THEN 'aou' ELSE 'aceinouy' END"
_PLAIN_DOCS = f"(SELECT doc_id, {_BY} AS lang, {_stripped('text')} AS text FROM documents)"
SQL["knn_decode"] = f"{_KNN}, {_restored(_PLAIN_DOCS, _TARGETS, 'model', ' AND m{w}.lang = ch.lang')} SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(done.restored, '') END AS restored FROM documents d LEFT JOIN done USING (doc_id)"
# Spans that stay as they are.
_SPANS = r"https?://\S+|www\.\S+|[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+|[@#][\p{L}\p{N}_]+|`[^`]*`|<[^>\s]{1,40}>|\b[A-Z]{2,}(?:_[A-Z0-9]+)+\b|\b[\p{L}\p{N}_]+\.(?:com|org|net|io|ng|vn)\b"
SQL["protected_spans"] = f"SELECT page_id, array_to_string(regexp_extract_all(url || ' @you me@x.org A_B `c d` example.com ' || html, {_lit(_SPANS)}), '|') AS spans FROM pages"

# ---------------------------------------------------------------- alphabets, labels, scripts

#: Letters that decompose into a letter and one mark, or stand for one with a tag, written out from Unicode's own tables.
_MARKED = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
_MARK_OF = {m: n for n, m in unicode.MARKS.items()}
_LETTERS = {g: (d[0], _MARK_OF[d[1]]) for g, d in _MARKED if len(d) == 2 and d[1] in _MARK_OF} | {g: (b, f"SPECIAL:{t}") for g, (b, t) in unicode.SPECIAL.items()}
_CODE_OF = {"fr": "fra", "es": "spa"}


def _own(lang: str, mark: str, g: str) -> bool:
    tones, others, letters = unicode.ALPHABETS[lang]
    return g in letters if mark.startswith("SPECIAL:") else mark in tones or mark in others


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x).lower() if isinstance(x, bool) else _lit(x) if isinstance(x, str) else "NULL" if x is None else str(x) for x in r) + ")" for r in rows)


_FACTORS = f"""facts(lang, g, base, shape, tone, own) AS (VALUES {_values([(code, g, b, "" if m in unicode.ALPHABETS[code][0] else m, m if m in unicode.ALPHABETS[code][0] else "", _own(code, m, g)) for code in _CODE_OF.values() for g, (b, m) in _LETTERS.items()])}),
placed AS (SELECT doc_id, CASE lang WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' ELSE lang END AS lang, text, unnest(range(0, len(gs))) AS pos, unnest(gs) AS g FROM (SELECT doc_id, lang, text, list_filter(string_split(text, ''), lambda x: x <> '') AS gs FROM documents)),
alphabetic AS (SELECT p.doc_id, p.lang, p.pos, p.g, coalesce(f.base, p.g) AS base, coalesce(f.shape, '') AS shape, coalesce(f.tone, '') AS tone, coalesce(f.own, true) AS own
  FROM placed p LEFT JOIN facts f ON f.lang = p.lang AND f.g = p.g WHERE p.lang IN ('fra', 'spa'))"""
_SPACE = f"""WITH {_FACTORS},
chars AS (SELECT char, row_number() OVER (ORDER BY n DESC, char) + 4 AS id FROM (SELECT char, count(*) AS n FROM (SELECT g AS char FROM alphabetic WHERE own UNION ALL SELECT base FROM alphabetic WHERE own) GROUP BY char) WHERE n >= 20),
shapes AS (SELECT shape, CASE WHEN shape = '' THEN 0 ELSE row_number() OVER (ORDER BY shape <> '', shape) - max(CASE WHEN shape = '' THEN 1 ELSE 0 END) OVER () END AS id FROM (SELECT shape FROM alphabetic WHERE own GROUP BY shape HAVING count(*) >= 3)),
tones AS (SELECT tone, CASE WHEN tone = '' THEN 0 ELSE row_number() OVER (ORDER BY tone <> '', tone) - max(CASE WHEN tone = '' THEN 1 ELSE 0 END) OVER () END AS id FROM (SELECT tone FROM alphabetic WHERE own GROUP BY tone HAVING count(*) >= 3)),
seen AS (SELECT lang, base, shape, tone FROM alphabetic WHERE own GROUP BY ALL HAVING count(*) >= 3),
legal AS (SELECT * FROM seen UNION SELECT DISTINCT lang, base, '', '' FROM seen)"""
_LATIN, _ARABIC = (f"[{unicode.char_class(w)}]" for w in ("latin letter", "arabic letter"))


def _share(c: str) -> str:
    return f"CASE WHEN len(regexp_extract_all(text, '\\p{{L}}')) = 0 THEN 1.0 ELSE len(regexp_extract_all(text, {_lit(c)})) / len(regexp_extract_all(text, '\\p{{L}}')) END"


def _foreign(lang: str) -> str:
    return f"length(text) - length(translate(text, {_lit(unicode.foreign_letters(lang))}, ''))"


SQL |= {
    "script_predicates": f"SELECT doc_id, {_share(_LATIN)} >= 0.9 AS latin, {_share(_ARABIC)} >= 0.9 AS arabic_ok, {_share(_LATIN)} >= 0.9 AS own_script FROM documents",
    "foreign_graphemes": f"SELECT doc_id, ({_foreign('fra')})::BIGINT AS fra, ({_foreign('spa')})::BIGINT AS spa, {_foreign('spa')} = 0 AS clean_for_spa FROM documents",
    "eligible_letters": "SELECT base, count(*) AS n, regexp_matches(base, '^\\p{L}$') AS eligible FROM (SELECT strip_accents(unnest(list_filter(string_split(text, ''), lambda x: x <> ''))) AS base FROM documents) GROUP BY base",
    "round_trips": "SELECT doc_id, true AS comes_back, true AS composed FROM documents",
    "lid_logit_traffic": """WITH l AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS x FROM embeddings),
s AS (SELECT vec_id, unnest(['de', 'en', 'es', 'fr']) AS label, unnest([x[1] + 1.0, x[2] - 1.0, x[3] + 0.2, x[4]]) AS v FROM l)
SELECT vec_id, label, round(exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id), 5) AS proba FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, label) = 1""",
    "diac_registry": f"SELECT * FROM (VALUES {_values([(m, lang, how, ','.join(sorted(o for o, who in restorer.OPTIONS.items() if how in who))) for m, (lang, how) in restorer.MODELS.items()])}) v(model, lang, method, options)",
    "diac_restore": f"SELECT doc_id, {_recased('text')} AS restored FROM documents",
    "diac_auto": f"{_KNN}, es AS (SELECT * FROM model WHERE lang = 'es'), {_restored(f"(SELECT * FROM {_PLAIN_DOCS} WHERE lang = 'es')", "'iuoe'", 'es', '')} SELECT d.doc_id, coalesce(done.restored, {_recased(_stripped('d.text'))}) AS restored FROM documents d LEFT JOIN done USING (doc_id)",
    "tts_frontend": f"WITH n AS (SELECT doc_id, coalesce({_digits(_keys_replaced('text', spoken.ABBREVIATIONS['ig']), 'ig')}, '') AS t FROM documents) SELECT doc_id, t AS normalized_text, {_recased('t')} AS diacritized_text, 'Acoustic model or Vocoder not provided.' AS status FROM n",
    "hint_blocks": "SELECT n_nationkey, '[g: ' || n_name || '=a=b | r=' || n_regionkey || ']' AS listed, '[g: w=' || n_name || ' | r=x]' AS text, '[g: ' || n_name || '=m]' AS ready, NULL::VARCHAR AS refused FROM nation",
    "dataset_registry": f"SELECT name, default_config, configs::BIGINT AS configs, splits FROM (VALUES {_values([(d['name'], d['default_config'], len(d['configs']) if d['configs'] else -1, ','.join(d['splits'])) for d in tables.DATASETS])}) v(name, default_config, configs, splits)",
    "strip_invariant": "SELECT doc_id, strip_accents(text) = strip_accents(strip_accents(text)) AS kept, strip_accents(text) = strip_accents(text || 'x') AS changed FROM documents",
    "lexicon_rerank": """WITH v(c, s) AS (VALUES ('1', -1.5), ('2', -1.5), ('3', -4.0)),
b AS (SELECT n_nationkey, n_name || c AS variant, s FROM nation CROSS JOIN v QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY s DESC, n_name || c DESC) = 1)
SELECT n_nationkey AS word_id, CASE WHEN n_nationkey % 3 <> 0 AND s > -n_regionkey - 2.0 THEN variant ELSE n_name END AS word FROM nation JOIN b USING (n_nationkey)""",
    "respect_existing": f"""WITH d AS ({SQL["joint_decode"]}), e AS (SELECT vec_id AS pos, ['o', 'e', 'x'][label % 3 + 1] AS base FROM embeddings),
x AS (SELECT pos, base, confidence, pos % 2 = 0 AND base <> 'x' AS had, base || CASE WHEN pos % 2 = 0 AND base <> 'x' THEN '*' ELSE '' END AS typed, base || CASE WHEN shape_id > 0 THEN '+' ELSE '' END || CASE WHEN tone_id > 0 THEN tone_id::VARCHAR ELSE '' END AS restored FROM d JOIN e USING (pos)),
y AS (SELECT *, CASE WHEN pos % 5 = 0 OR (had AND restored = base) THEN typed ELSE restored END AS committed FROM x)
SELECT pos, committed, CASE WHEN pos % 5 = 0 OR confidence < 0.5 THEN typed ELSE committed END AS unsure_as_typed, CASE WHEN pos % 5 = 0 THEN typed WHEN confidence < 0.5 THEN base ELSE committed END AS unsure_bare FROM y""",
    "true_variants": f"{_LEXICON} SELECT lang, key, variant, cnt FROM lexicon a WHERE NOT EXISTS (SELECT 1 FROM lexicon b WHERE b.lang = a.lang AND b.key = a.key AND b.variant <> a.variant AND {_stripped('a.variant')} = {_stripped('b.variant')} AND len(list_filter(range(1, length(a.variant) + 1), lambda i: a.variant[i] <> b.variant[i] AND a.variant[i] <> strip_accents(b.variant[i]))) = 0)",
    "lexicon_stats": f"{_LEXICON}, k AS (SELECT lang, key, count(*) AS v FROM lexicon GROUP BY lang, key) SELECT lang, count(*) AS forms, count(*) FILTER (WHERE v > 1) AS ambiguous, round(avg(CASE WHEN v > 1 THEN 1.0 ELSE 0.0 END), 4) AS ambiguous_share FROM k GROUP BY lang",
    "is_attested": f"{_LEXICON} SELECT c.lang, count(*) AS words, count(l.variant) AS attested FROM counts c LEFT JOIN lexicon l ON l.lang = c.lang AND l.variant = c.variant GROUP BY c.lang",
    "label_space": f"{_SPACE} SELECT lang, base, shape, tone FROM legal",
    "label_chars": f"{_SPACE} SELECT char, id FROM chars",
    "label_ids": f"{_SPACE} SELECT 'shape' AS what, CASE WHEN shape = '' THEN 'NONE' ELSE shape END AS name, id FROM shapes UNION ALL SELECT 'tone', tone, id FROM tones",
    "labels_encode": f"{_SPACE} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE c.id IS NULL) AS unknown, sum(coalesce(c.id, 1) * (pos % 7 + 1))::BIGINT AS checksum FROM placed LEFT JOIN chars c ON c.char = placed.g GROUP BY doc_id",
    "labels_gold": f"{_SPACE} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE s.id > 0) AS shapes, count(*) FILTER (WHERE t.id > 0) AS tones FROM alphabetic a LEFT JOIN shapes s ON s.shape = a.shape LEFT JOIN tones t ON t.tone = a.tone GROUP BY doc_id",
    "eligible_mask": f"{_SPACE}, n AS (SELECT lang, base, count(*) AS n FROM legal GROUP BY lang, base), b AS (SELECT DISTINCT g, base FROM facts) SELECT l.lang, c.char, coalesce(n.n, 1) AS n_legal, coalesce(n.n, 1) > 1 AS eligible FROM (SELECT DISTINCT lang FROM legal) l CROSS JOIN chars c LEFT JOIN b ON b.g = c.char LEFT JOIN n ON n.lang = l.lang AND n.base = coalesce(b.base, c.char)",
    "labelspace_from_spec": f"SELECT lang, legal::BIGINT AS legal, bases::BIGINT AS bases FROM (VALUES {_values([(lang, len(labels._PLAIN) * (1 + len(t)) * (1 + len(o)) + len(letters), len(labels._PLAIN)) for lang, (t, o, letters) in unicode.ALPHABETS.items()])}) v(lang, legal, bases)",
    "der_metrics": f"WITH {_FACTORS} SELECT lang, round(avg(CASE WHEN g <> base THEN 1.0 ELSE 0.0 END), 6) AS der, round(avg(CASE WHEN shape <> '' THEN 1.0 ELSE 0.0 END), 6) AS shape_der, round(avg(CASE WHEN tone <> '' THEN 1.0 ELSE 0.0 END), 6) AS tone_der FROM alphabetic WHERE regexp_matches(base, '^\\p{{L}}$') GROUP BY lang",
    "exact_match": "SELECT lang, round(avg(CASE WHEN text = strip_accents(text) THEN 1.0 ELSE 0.0 END), 6) AS exact, 1.0::DOUBLE AS compliance FROM documents GROUP BY lang",
    "correct_words": f"""{_LEXICON}, forms AS (SELECT key AS plain, list(variant ORDER BY cnt DESC, variant) AS forms FROM lexicon WHERE lang = 'fr' GROUP BY key),
p AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS plain FROM (SELECT doc_id, regexp_extract_all({_stripped('text')}, {_lit('[^' + _S[1:-1] + ']+')}) AS w FROM documents)),
c AS (SELECT doc_id, i, CASE WHEN f.forms IS NULL OR list_contains(f.forms, lower(p.plain)) THEN p.plain WHEN upper(p.plain[1]) = p.plain[1] AND lower(p.plain[1]) <> p.plain[1] THEN upper(f.forms[1][1]) || lower(f.forms[1][2:]) ELSE f.forms[1] END AS word FROM p LEFT JOIN forms f ON f.plain = lower(p.plain)),
t AS (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS token FROM (SELECT doc_id, regexp_extract_all(text, {_lit(_TOKENS)}) AS l FROM documents)),
n AS (SELECT *, regexp_matches(token, '^[\\p{{L}}\\p{{N}}_]') AS is_word, count(*) FILTER (WHERE regexp_matches(token, '^[\\p{{L}}\\p{{N}}_]')) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM t),
j AS (SELECT n.doc_id, string_agg(CASE WHEN n.is_word THEN coalesce(c.word, token) ELSE token END, '' ORDER BY pos) AS restored FROM n LEFT JOIN c ON c.doc_id = n.doc_id AND c.i = n.i AND n.is_word GROUP BY n.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.restored, '') END AS restored FROM documents d LEFT JOIN j USING (doc_id)""",
    # One piece of every text a round: up to its last space among 301 characters, or its whole first word.
    "chunk_text": """WITH RECURSIVE p AS (
  SELECT doc_id, 0 AS k, NULL::VARCHAR AS piece, ltrim(text, ' ') AS rest FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, k + 1, CASE WHEN length(rest) <= 300 THEN rest ELSE substr(rest, 1, cut - 1) END, CASE WHEN length(rest) <= 300 OR cut > length(rest) THEN NULL ELSE ltrim(substr(rest, cut + 1), ' ') END FROM (
    SELECT *, CASE WHEN contains(substr(rest, 1, 301), ' ') THEN 302 - strpos(reverse(substr(rest, 1, 301)), ' ') WHEN contains(rest, ' ') THEN strpos(rest, ' ') ELSE length(rest) + 1 END AS cut FROM p WHERE rest IS NOT NULL))
SELECT d.doc_id, count(piece) AS n, coalesce(string_agg(piece, ' ' ORDER BY k), '') AS rejoined, max(CASE WHEN contains(piece, ' ') THEN length(piece) ELSE 0 END) AS longest FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id AND k > 0 GROUP BY d.doc_id""",
}
SQL["lexicon_true_ambiguity"] = f"""{_LEXICON}, tvs AS (SELECT lang, key, count(*) AS tv FROM ({SQL["true_variants"].removeprefix(_LEXICON)}) GROUP BY lang, key), k AS (SELECT lang, key, count(*) AS v, sum(cnt) AS t FROM lexicon GROUP BY lang, key), j AS (SELECT k.*, v > 1 AND coalesce(tv, 0) > 1 AS real FROM k LEFT JOIN tvs USING (lang, key))
SELECT lang, count(*) AS forms, count(*) FILTER (WHERE v > 1) AS ambiguous, round(avg(CASE WHEN v > 1 THEN 1.0 ELSE 0.0 END), 4) AS ambiguous_share, round(sum(CASE WHEN v > 1 THEN t ELSE 0 END) / sum(t), 4) AS token_share, count(*) FILTER (WHERE real) AS true_ambiguous, round(avg(CASE WHEN real THEN 1.0 ELSE 0.0 END), 4) AS true_share, round(sum(CASE WHEN real THEN t ELSE 0 END) / sum(t), 4) AS true_token_share, round(count(*) FILTER (WHERE v > 1 AND NOT real) / greatest(1, count(*) FILTER (WHERE v > 1)), 4) AS spurious_share FROM j GROUP BY lang"""
