"""DuckDB SQL with the same rows as the queries, on the same tables."""

from __future__ import annotations

from tagweave.functions.text import CLEANING, STOP_WORDS, TRANSIENT
from tagweave.operators.index import K1, B

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOK = r"[\p{L}\p{N}]+"
_ALL, _ANY = "0123456789abcdef", "1=1"


def _with(*parts: str) -> str:
    """The named CTEs, with those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for p in parts:
        add(p)
    return "WITH " + ", ".join(f"{n} AS ({_CTE[n]})" for n in order) + " "


_BITS = ", ".join(f"sum(n * ((h1 >> {b}) & 1)) AS u{b}, sum(n * ((h2 >> {b}) & 1)) AS l{b}" for b in range(32))
_HALF = lambda k: " + ".join(f"(CASE WHEN 2 * {k}{b} > n THEN {1 << b} ELSE 0 END)" for b in range(32))
_SIGNED = "CAST((CASE WHEN hi >= 2147483648 THEN hi - 4294967296 ELSE hi END) * 4294967296 + lo AS BIGINT)"


def _simhash(rows: str) -> str:
    """(id, simhash) of (id, term, n) rows."""
    return f"""SELECT id, {_SIGNED} AS simhash FROM (
      SELECT id, CAST({_HALF("u")} AS BIGINT) AS hi, CAST({_HALF("l")} AS BIGINT) AS lo FROM (
        SELECT id, sum(n) AS n, {_BITS} FROM (
          SELECT id, n, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(md5(term), 9, 8) AS BIGINT) AS h2 FROM ({rows}))
        GROUP BY id))"""


_PART = f"ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * {K1 + 1} / (n + {K1} * (1 - {B} + {B} * dl / avgdl))"
_CTE = {
    "tok": f"SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM documents",
    "tf": "SELECT doc_id, term, count(*) AS n FROM tok GROUP BY doc_id, term",
    "ktf": f"SELECT * FROM tf WHERE term NOT IN ({_STOP})",
    "kw": "SELECT doc_id, term, n / max(n) OVER (PARTITION BY doc_id) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM ktf",
    "edges": "SELECT doc_id AS atom_id, '#' || term AS tag FROM kw WHERE rank <= 10 AND score >= 0.3",
    "fps": _simhash("SELECT doc_id AS id, term, n FROM tf"),
    "prints": "SELECT d.doc_id, coalesce(f.simhash, 0) AS simhash FROM documents d LEFT JOIN fps f ON d.doc_id = f.id",
    "atoms": "SELECT doc_id AS atom_id, source, text, epoch_ms((1704067200 + 60 * doc_id) * 1000) AS ts FROM documents",
    "pairs": "SELECT a.tag AS a, b.tag AS b, count(*) AS n FROM edges a JOIN edges b ON a.atom_id = b.atom_id AND a.tag < b.tag GROUP BY 1, 2",
    "tagn": "SELECT tag, count(*) AS n FROM edges GROUP BY tag",
    "cooc": "SELECT a, b, CAST(n AS DOUBLE) AS weight FROM pairs WHERE n >= 2",
    "jacc": "SELECT * FROM (SELECT a, b, round(p.n / (x.n + y.n - p.n), 9) AS weight FROM pairs p JOIN tagn x ON p.a = x.tag JOIN tagn y ON p.b = y.tag) WHERE weight >= 0.5",
    "cls": "SELECT simhash, min(doc_id) AS rep FROM prints GROUP BY simhash",
    "close": "SELECT a.rep AS a, b.rep AS b, CAST(bit_count(xor(a.simhash, b.simhash)) AS BIGINT) AS distance FROM cls a JOIN cls b ON a.rep < b.rep WHERE bit_count(xor(a.simhash, b.simhash)) <= 5",
    "ctags": "SELECT DISTINCT c.rep, e.tag FROM edges e JOIN prints p ON e.atom_id = p.doc_id JOIN cls c ON p.simhash = c.simhash",
    "fpsyn": "SELECT least(t.tag, u.tag) AS a, greatest(t.tag, u.tag) AS b, round(1 - min(distance) / 64.0::DOUBLE, 9) AS weight FROM close JOIN ctags t ON a = t.rep JOIN ctags u ON b = u.rep WHERE t.tag <> u.tag GROUP BY 1, 2",
    "allsyn": "SELECT a, b FROM cooc UNION SELECT a, b FROM jacc UNION SELECT a, b FROM fpsyn",
    "rings": "SELECT tag, list_sort(list(DISTINCT syn)) AS synonyms FROM (SELECT a AS tag, b AS syn FROM allsyn UNION SELECT b, a FROM allsyn) GROUP BY tag",
    "q": "SELECT unnest(['er', 'on', 'th']) AS term",
    "qk": f"SELECT term FROM q WHERE term NOT IN ({_STOP})",
    "qh": "SELECT simhash FROM (" + _simhash("SELECT 0 AS id, term, 1 AS n FROM q") + ")",
    "planet": "SELECT atom_id, count(*) AS shared, 0 AS hop FROM edges WHERE tag IN (SELECT '#' || term FROM qk) GROUP BY atom_id",
    "t1": "SELECT DISTINCT tag FROM edges WHERE atom_id IN (SELECT atom_id FROM planet) AND tag NOT IN (SELECT '#' || term FROM qk)",
    "moon1": "SELECT atom_id, count(*) AS shared, 1 AS hop FROM edges WHERE tag IN (SELECT tag FROM t1) AND atom_id NOT IN (SELECT atom_id FROM planet) GROUP BY atom_id",
    "t2": "SELECT DISTINCT tag FROM edges WHERE atom_id IN (SELECT atom_id FROM moon1) AND tag NOT IN (SELECT '#' || term FROM qk) AND tag NOT IN (SELECT tag FROM t1)",
    "moon2": "SELECT atom_id, count(*) AS shared, 2 AS hop FROM edges WHERE tag IN (SELECT tag FROM t2) AND atom_id NOT IN (SELECT atom_id FROM planet UNION SELECT atom_id FROM moon1) GROUP BY atom_id",
    "t3": "SELECT DISTINCT tag FROM edges WHERE atom_id IN (SELECT atom_id FROM moon2) AND tag NOT IN (SELECT '#' || term FROM qk UNION SELECT tag FROM t1 UNION SELECT tag FROM t2)",
    "moon3": "SELECT atom_id, count(*) AS shared, 3 AS hop FROM edges WHERE tag IN (SELECT tag FROM t3) AND atom_id NOT IN (SELECT atom_id FROM planet UNION SELECT atom_id FROM moon1 UNION SELECT atom_id FROM moon2) GROUP BY atom_id",
    "bm25": f"""SELECT doc_id AS atom_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * {K1 + 1} / (n + {K1} * (1 - {B} + {B} * dl / avgdl))), 9) AS score
      FROM tf JOIN (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term) USING (term) JOIN (SELECT doc_id, sum(n) AS dl FROM tf GROUP BY doc_id) USING (doc_id)
      CROSS JOIN (SELECT count(*) AS docs, avg(dl) AS avgdl FROM (SELECT doc_id, sum(n) AS dl FROM tf GROUP BY doc_id)) GROUP BY doc_id HAVING count(*) = (SELECT count(*) FROM q)""",
    "anybm": f"""SELECT doc_id AS atom_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * {K1 + 1} / (n + {K1} * (1 - {B} + {B} * dl / avgdl))), 9) AS score
      FROM tf JOIN (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term) USING (term) JOIN lens USING (doc_id) CROSS JOIN whole GROUP BY doc_id""",
    "pos": f"SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS loc FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_TOK}') AS t FROM documents)",
    "lens": "SELECT doc_id, count(*) AS dl FROM tok GROUP BY doc_id",
    "whole": "SELECT count(*) AS docs, avg(dl) AS avgdl FROM lens",
    "phrases": """SELECT a.doc_id, 0 AS unit, count(*) AS n FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.loc = a.loc + 1 WHERE a.term = 'the' AND b.term = 'and' GROUP BY 1
      UNION ALL SELECT a.doc_id, 1, count(*) FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.loc = a.loc + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1
      UNION ALL SELECT doc_id, 2, count(*) FROM pos WHERE starts_with(term, 'tion') GROUP BY 1
      UNION ALL SELECT doc_id, 3, count(*) FROM (SELECT DISTINCT a.doc_id, a.loc FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.loc BETWEEN a.loc - 4 AND a.loc - 1
        WHERE (a.term, b.term) IN (('in', 'that'), ('that', 'in'))) GROUP BY 1
      UNION ALL SELECT a.doc_id, 4, count(*) FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.loc = a.loc + 1 WHERE a.term = 'de' AND b.term = 'de' GROUP BY 1""",
    "places": """SELECT a.doc_id, 0 AS which, a.loc FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.loc = a.loc + 1 WHERE a.term = 'of' AND b.term = 'the'
      UNION ALL SELECT doc_id, 1, loc FROM pos WHERE term = 'to' UNION ALL SELECT doc_id, 2, loc FROM pos WHERE starts_with(term, 'i')""",
    "lasts": "SELECT doc_id, loc, " + ", ".join(f"max(CASE WHEN which = {j} THEN loc END) OVER (PARTITION BY doc_id ORDER BY loc) AS l{j}" for j in range(3)) + " FROM places",
    "nearby": """SELECT doc_id, 0 AS unit, count(*) AS n FROM lasts WHERE l0 IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL
        AND loc - (least(l0, l1, l2) + CASE WHEN l0 = least(l0, l1, l2) THEN 2 ELSE 1 END) <= 4 GROUP BY doc_id
      UNION ALL SELECT doc_id, 1, count(*) FROM pos WHERE term = 'the' AND loc = 0 GROUP BY doc_id""",
    "seeds": "SELECT atom_id FROM bm25 ORDER BY score DESC, atom_id LIMIT 100",
    "h1": "SELECT DISTINCT atom_id FROM edges WHERE tag IN (SELECT tag FROM edges WHERE atom_id IN (SELECT atom_id FROM seeds)) AND atom_id NOT IN (SELECT atom_id FROM seeds)",
    "h2": "SELECT DISTINCT atom_id FROM edges WHERE tag IN (SELECT tag FROM edges WHERE atom_id IN (SELECT atom_id FROM h1)) AND atom_id NOT IN (SELECT atom_id FROM seeds UNION SELECT atom_id FROM h1)",
    "near": "SELECT * FROM (SELECT atom_id, 0 AS hop FROM seeds UNION ALL SELECT atom_id, 1 FROM h1 UNION ALL SELECT atom_id, 2 FROM h2) ORDER BY hop, atom_id LIMIT 1000",
    "win": "SELECT id, term, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(substr(hx, 2 * o + 1), '.{16}')) AS term FROM (SELECT atom_id AS id, hex(encode(text)) AS hx FROM near JOIN documents ON atom_id = doc_id), range(8) r(o)) GROUP BY 1, 2",
    "wprint": _simhash("SELECT id, term, n FROM win"),
    "met": "SELECT n.atom_id, n.hop, d.source, d.text, coalesce(p.simhash, 0) AS simhash, CASE WHEN strlen(d.text) < 8 THEN md5(d.text) ELSE '' END AS short FROM near n JOIN documents d ON n.atom_id = d.doc_id LEFT JOIN wprint p ON p.id = n.atom_id",
    "uni": "SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY simhash, short ORDER BY hop, atom_id) = 1",
    "talk": "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "md": "SELECT conv_id, string_agg('# ' || role || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "log": """SELECT user_id, string_agg(CASE event_type WHEN 'error' THEN 'Error: code ' || json_extract_string(props, '$.k') WHEN 'click' THEN 'npm WARN click ' || json_extract_string(props, '$.k')
      ELSE event_type || ' seen' END, chr(10) ORDER BY event_id) AS text FROM events GROUP BY user_id""",
    "src": "SELECT source AS id, count(*) AS docs FROM documents GROUP BY source",
    "path": "SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages",
    "li": "SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem",
}
_NEEDS = {
    "tf": ("tok",), "ktf": ("tf",), "kw": ("ktf",), "edges": ("kw",), "fps": ("tf",), "prints": ("fps",), "pairs": ("edges",), "tagn": ("edges",), "cooc": ("pairs",), "jacc": ("pairs", "tagn"),
    "cls": ("prints",), "close": ("cls",), "ctags": ("edges", "cls"), "fpsyn": ("close", "ctags"), "allsyn": ("cooc", "jacc", "fpsyn"), "rings": ("allsyn",), "qh": ("q",), "qk": ("q",), "planet": ("edges", "qk"),
    "t1": ("planet",), "moon1": ("t1",), "t2": ("moon1",), "moon2": ("t2",), "t3": ("moon2",), "moon3": ("t3",), "bm25": ("tf", "q"), "anybm": ("tf", "q", "lens", "whole"), "lens": ("tok",), "whole": ("lens",), "phrases": ("pos",), "lasts": ("places",), "places": ("pos",), "nearby": ("lasts",), "seeds": ("bm25",), "h1": ("seeds", "edges"), "h2": ("h1",), "near": ("h2",), "win": ("near",), "wprint": ("win",), "met": ("wprint",), "uni": ("met",),
}



def _clean(column: str) -> str:
    for _, pattern, instead in CLEANING:
        column = f"regexp_replace({column}, '{pattern}', '{instead}', 'g')"
    return f"trim({column}, ' ')"


_LINE = "(?i)" + "|".join(f"(?:{p})" for family in TRANSIENT.values() for p in family)


def _transient(rows: str, key: str, ratio: float) -> str:
    return f"""WITH t AS ({rows}), s AS (SELECT {key}, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS l0 FROM t),
      l AS (SELECT {key}, CASE WHEN l0[len(l0)] = '' THEN l0[1:len(l0) - 1] ELSE l0 END AS l FROM s),
      c AS (SELECT {key}, CAST(len(l) AS BIGINT) AS total, CAST(len(list_filter(l, lambda x: regexp_matches(x, '{_LINE}'))) AS BIGINT) AS hits FROM l)
      SELECT {key}, total, hits AS transient, round(CASE WHEN total > 0 THEN hits / total ELSE 0 END, 9) AS ratio, total >= 5 AND hits > {ratio} * total AS is_transient FROM c"""


def _atomize(rows: str, key: str, sep: str, content: str) -> str:
    return f"""WITH t AS ({rows}), p AS (SELECT {key}, regexp_extract_all(text, '(?s).+?(?:{sep}|\\z)') AS ps FROM t),
      u AS (SELECT {key}, unnest(ps) AS piece, unnest(range(len(ps))) AS seq FROM p),
      w AS (SELECT {key}, seq, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY {key} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start,
        regexp_replace(piece, '(?:{sep})\\z', '') AS content FROM u)
      SELECT {key}, seq, char_start, char_start + length(content) AS char_end{content} FROM w WHERE content <> ''"""


def _found(decay: float, gamma: float, hops: int, *more: str) -> str:
    names = ["planet", *(f"moon{k}" for k in range(1, hops + 1))]
    rows = " UNION ALL ".join(f"SELECT atom_id, shared, hop FROM {n}" for n in names)
    return _with(*more, *names, "atoms", "prints", "qh") + f""", f AS (SELECT f.atom_id, CASE WHEN hop = 0 THEN 'planet' ELSE 'moon' END AS kind, CAST(hop AS BIGINT) AS hop, shared AS shared_tags,
      round(shared * exp(-{decay!r} * abs(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(a.ts)) / (1e6 * 3600)) * (1 - bit_count(xor(p.simhash, q.simhash)) / 64.0::DOUBLE) * pow({gamma}, hop), 6) AS relevance
      FROM ({rows}) f JOIN atoms a USING (atom_id) JOIN prints p ON p.doc_id = f.atom_id CROSS JOIN qh q)"""


_TOP = "ORDER BY relevance DESC, atom_id LIMIT"


def _star(found: str) -> str:
    return found + f""", p AS (SELECT * FROM f WHERE kind = 'planet' AND relevance >= 0.1 {_TOP} 35),
      m AS (SELECT * FROM f WHERE kind = 'moon' AND relevance >= 0.1 {_TOP} (50 - (SELECT count(*) FROM p))), star AS (SELECT * FROM p UNION ALL SELECT * FROM m)"""


_STAR, _RECALL = _star(_found(0.00001, 0.85, 1)), _star(_found(0.0, 0.75, 3))
_WORDS = r"len(regexp_extract_all(text, '\S+'))"
_BUDGET = _found(0.00001, 0.85, 1) + f""", z AS (SELECT doc_id AS atom_id, CAST({_WORDS} AS BIGINT) AS tokens FROM documents),
  k AS ((SELECT * FROM f WHERE kind = 'planet' AND relevance >= 0.1 {_TOP} 50) UNION ALL (SELECT * FROM f WHERE kind = 'moon' AND relevance >= 0.1 {_TOP} 50)),
  r AS (SELECT k.*, tokens, CAST(sum(tokens) OVER (PARTITION BY kind ORDER BY relevance DESC, atom_id) AS BIGINT) AS running FROM k JOIN z USING (atom_id)),
  budget AS (SELECT * FROM r WHERE running <= CASE WHEN kind = 'planet' THEN 5734 ELSE 2457 END)"""


#: The tags that lead to each atom: the least of them by order.
_PATHS = """, pt AS (SELECT atom_id, min([tag]) AS path FROM edges WHERE tag IN (SELECT '#' || term FROM qk) GROUP BY atom_id),
  pn AS (SELECT tag, min(list_append(path, tag)) AS path FROM edges JOIN pt USING (atom_id) WHERE tag IN (SELECT tag FROM t1) GROUP BY tag),
  pm AS (SELECT atom_id, min(path) AS path FROM edges JOIN pn USING (tag) WHERE atom_id IN (SELECT atom_id FROM moon1) GROUP BY atom_id)"""
_RAW = _found(0.00001, 0.85, 1, "seeds").replace("(SELECT unnest(['er', 'on', 'th']) AS term)", "(SELECT unnest(['the', 'of']) AS term)")


def _illuminate(depth: int) -> str:
    rows = " UNION ALL ".join(["SELECT atom_id, 0 AS hop FROM seeds", *(f"SELECT atom_id, {h} FROM h{h}" for h in range(1, depth + 1))])
    return _with("seeds", *(f"h{h}" for h in range(1, depth + 1))) + f"SELECT atom_id, CAST(hop AS BIGINT) AS hop_distance, round(pow(0.85, hop * (hop + 1) / 2), 9) AS gravity_score FROM ({rows}) ORDER BY hop, atom_id LIMIT 300"


def _gravity(factor: str, damp: str) -> str:
    return f"round(2.0 * exp(-0.00001 * abs(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / (1e6 * {factor})) * (1 - (atom_id % 64) / 64.0::DOUBLE) * pow(0.85, {damp}), 9)"


SQL = {
    "tokenize_docs": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, list_min(t) AS first_token FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_TOK}') AS t FROM documents)",
    "token_counts": f"SELECT doc_id, CAST({_WORDS} AS BIGINT) AS n_words FROM documents",
    "sanitize_pages": f"SELECT page_id, {_clean('html')} AS content FROM pages",
    "sanitize_whitespace": r"""SELECT doc_id, trim(regexp_replace(c, '[ \t\n\r]+', ' ', 'g'), ' ') AS content, CAST(length(trim(regexp_replace(regexp_replace(c, '[^\x00-\x7F]', '', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ')) AS BIGINT) AS n_ascii
      FROM (SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS c FROM documents)""",
    "atomize_talks": _atomize(_CTE["talk"], "conv_id", r"\n\n+", ", content"),
    "line_atoms": _atomize("SELECT doc_id, text FROM documents", "doc_id", r"\n+", ""),
    "molecules_talks": "WITH md AS (" + _CTE["md"] + r"""), p AS (SELECT conv_id, string_split(regexp_replace(text, '(?m)^(#{1,3} )', chr(1) || '\1', 'g'), chr(1)) AS ps FROM md),
      u AS (SELECT conv_id, unnest(ps) AS content, unnest(range(len(ps))) AS seq FROM p), n AS (SELECT conv_id, content, seq - 1 AS seq FROM u WHERE content <> '')
      SELECT conv_id, seq, CASE WHEN regexp_matches(content, '\A#{1,3} ') THEN regexp_extract(content, '\A#{1,3} ([^\n]*)', 1) END AS header, content FROM n""",
    "hashtags_pages": r"SELECT page_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(concat_ws(' ', url, html), '#([\p{L}\p{N}_]+)', 1), lambda x: '#' || lower(x)))), ' '), '') AS tags FROM pages",
    "transient_analyze": _transient(_CTE["log"], "user_id", 0.4),
    "transient_docs": _transient("SELECT doc_id, text FROM documents", "doc_id", 0.5),
    "read_range": r"SELECT doc_id, substr(text, 6, 20) AS chars, substr(hex(encode(text)), 7, 28) AS bytes, substr(text, 1, 200) AS snippet FROM documents",
    "read_lines": "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS content FROM documents",
    "context_inflation": "SELECT conv_id, turn, text, lag(text) OVER w AS before, lead(text) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "xml_context": """SELECT item_id, '<atom id="' || item_id || '" relevance="0.5000">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</atom>' AS xml FROM benchmark""",
    "simhash_docs": _with("prints") + "SELECT doc_id, simhash, printf('%016x', simhash) AS hex, CAST(bit_count(simhash) AS BIGINT) AS weight FROM prints",
    "simhash_bytes_items": "WITH g AS (SELECT item_id AS id, substr(hex(encode(text)), 2 * i - 1, 16) AS term, count(*) AS n FROM benchmark, range(1, 100000) r(i) WHERE i <= strlen(text) - 7 GROUP BY 1, 2), s AS ("
    + _simhash("SELECT id, term, n FROM g") + ") SELECT b.item_id, coalesce(s.simhash, 0) AS simhash FROM benchmark b LEFT JOIN s ON b.item_id = s.id",
    "hamming_pairs": _with("close") + "SELECT * FROM close",
    "fingerprint_classes": _with("prints") + "SELECT doc_id, min(doc_id) OVER (PARTITION BY simhash) AS representative, count(*) OVER (PARTITION BY simhash) AS members FROM prints",
    "similarity_topk": _with("prints") + """, s AS (SELECT q.doc_id AS query_id, p.doc_id AS id, bit_count(xor(p.simhash, q.simhash)) AS d FROM prints q JOIN prints p ON p.doc_id <> q.doc_id WHERE q.doc_id % 20 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM s) SELECT query_id, rank, id, round(1 - d / 64.0::DOUBLE, 9) AS similarity FROM r WHERE rank <= 20""",
    "gravity_docs": _with("atoms") + f"SELECT atom_id, {_gravity('3600', '2')} AS by_hour, {_gravity('1', '3')} AS by_second FROM atoms",
    "prefix_classes": "SELECT doc_id, min(doc_id) OVER w AS first_id, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY md5(substr(text, 1, 500)))",
    "keyword_tags": _with("edges") + "SELECT * FROM edges",
    "keywords_top": _with("kw") + "SELECT doc_id, term, round(score, 9) AS score, rank FROM kw WHERE rank <= 20",
    "tfidf_topk": _with("ktf") + """, d AS (SELECT term, count(*) AS df FROM ktf GROUP BY term), s AS (SELECT k.doc_id, k.term, k.n / sum(k.n) OVER (PARTITION BY k.doc_id) * (ln(((SELECT count(*) FROM documents) + 1) / (d.df + 1)) + 1) AS score FROM ktf k JOIN d USING (term)),
      r AS (SELECT doc_id, term, round(score, 9) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC, term) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""",
    "vocabulary": _with("tf") + "SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS n FROM tf GROUP BY term",
    "synonym_expand": _with("pairs") + "SELECT '#tion' AS term UNION SELECT b FROM pairs WHERE a = '#tion' AND n >= 3 UNION SELECT a FROM pairs WHERE b = '#tion' AND n >= 3",
    "bm25_any": _with("anybm") + "SELECT * FROM anybm ORDER BY score DESC, atom_id LIMIT 50",
    "bm25_phrase": _with("phrases", "whole") + f"""SELECT doc_id AS atom_id, round(sum(CASE WHEN unit < 4 THEN {_PART} ELSE 0 END), 9) AS score FROM phrases
      JOIN (SELECT unit, count(*) AS df FROM phrases GROUP BY unit) USING (unit) JOIN lens USING (doc_id) CROSS JOIN whole GROUP BY doc_id
      HAVING bool_or(unit IN (0, 1)) AND bool_or(unit IN (2, 3)) AND NOT bool_or(unit = 4) ORDER BY score DESC, atom_id LIMIT 100""",
    "match_near": _with("nearby", "whole") + f"""SELECT doc_id AS atom_id, round(sum({_PART}), 9) AS score FROM nearby
      JOIN (SELECT unit, count(*) AS df FROM nearby GROUP BY unit) USING (unit) JOIN lens USING (doc_id) CROSS JOIN whole GROUP BY doc_id""",
    "contained_docs": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT text, min(doc_id) AS class_id, count(*) AS members FROM d GROUP BY text),
      p AS (SELECT a.class_id, b.class_id AS container, strlen(b.text) AS n FROM c a JOIN c b ON strlen(b.text) > strlen(a.text) AND contains(b.text, a.text) WHERE strlen(a.text) >= 31),
      l AS (SELECT class_id, container FROM p QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY n DESC, container) = 1)
      SELECT doc_id, c.class_id, members, container FROM d JOIN c USING (text) LEFT JOIN l ON c.class_id = l.class_id""",
    "near_classes": _with("close").replace("WITH ", "WITH RECURSIVE ", 1) + """, u AS (SELECT a AS x, b AS y FROM close UNION SELECT b, a FROM close),
      r(node, reach) AS (SELECT rep, rep FROM cls UNION SELECT r.node, u.y FROM r JOIN u ON r.reach = u.x)
      SELECT p.doc_id AS atom_id, min(r.reach) AS class_id FROM prints p JOIN cls USING (simhash) JOIN r ON r.node = cls.rep GROUP BY p.doc_id""",
    "event_sessions": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, coalesce(value, 0) AS v, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL),
      b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY key ORDER BY us) <= 21600000000 THEN 0 ELSE 1 END AS new FROM e),
      s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY us) AS session FROM b),
      l AS (SELECT *, max(us) OVER (PARTITION BY key, session) AS last FROM s)
      SELECT key, min(ts) AS start, max(ts) AS "end", count(*) AS n, round(sum(v), 4) AS total, round(sum(v * exp(-0.1::DOUBLE * (last - us) / 3.6e9::DOUBLE)), 4) AS score FROM l GROUP BY key, session""",
    "chunk_ranges": """SELECT doc_id, substr(text, CAST(floor(length(text) / 3) AS BIGINT) + 1, 150) AS chars, substr(hex(encode(text)), CAST(2 * floor(strlen(text) / 3) AS BIGINT) + 1, 300) AS bytes
      FROM documents WHERE length(text) > 0""",
    "bm25_topk": _with("bm25") + "SELECT * FROM bm25 ORDER BY score DESC, atom_id LIMIT 50",
    "engine_stats": _with("edges") + "SELECT (SELECT count(*) FROM documents) AS atoms, (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT count(DISTINCT tag) FROM edges) AS tags",
    "list_sources": "SELECT source AS id, count(*) AS docs FROM documents GROUP BY source",
    "source_by_id": "SELECT source AS id, count(*) AS docs FROM documents WHERE source = 'src3' GROUP BY source",
    "atom_by_id": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id = 7",
    "distinct_tags": _with("edges") + "SELECT DISTINCT tag FROM edges",
    "tags_for_atom": _with("edges") + "SELECT tag FROM edges WHERE atom_id = 7",
    "atoms_by_tag": _with("edges") + "SELECT doc_id AS atom_id, source FROM documents WHERE doc_id IN (SELECT atom_id FROM edges WHERE tag = '#tion')",
    "atoms_by_source": "SELECT doc_id AS atom_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE source = 'src3'",
    "atoms_with_tags": _with("edges") + "SELECT d.doc_id AS atom_id, coalesce(string_agg(e.tag, ' ' ORDER BY e.tag), '') AS tags FROM documents d LEFT JOIN edges e ON d.doc_id = e.atom_id GROUP BY 1",
    "list_compounds": _with("edges", "src") + "SELECT id, docs AS atoms FROM src WHERE id IN (SELECT source FROM documents WHERE doc_id IN (SELECT atom_id FROM edges WHERE tag = '#tion')) OR id LIKE '%#tion%'",
    "upsert_source": "WITH n AS (SELECT doc_id + 5 AS doc_id, 'xx' AS lang, n_chars FROM documents WHERE doc_id % 10 = 0) SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n",
    "delete_source": _with("edges") + "SELECT * FROM edges WHERE atom_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3')",
    "ui_filters": _with("edges") + """, f AS (SELECT doc_id AS atom_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE source IN ('src1', 'src2', 'src3') AND length(text) > 0
      AND doc_id IN (SELECT atom_id FROM edges WHERE tag IN ('#tion', '#er'))), r AS (SELECT *, CAST(sum(n) OVER (ORDER BY atom_id) AS BIGINT) AS running FROM f) SELECT * FROM r WHERE running <= 40000""",
    "bucket_cube": "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY CUBE (source, lang)",
    "star_search": _STAR + " SELECT * FROM star",
    "star_planets_only": _found(0.00001, 0.85, 1) + f" SELECT * FROM f WHERE kind = 'planet' AND relevance >= 0.1 {_TOP} 50",
    "star_moons_only": _found(0.00001, 0.85, 1) + f" SELECT * FROM f WHERE kind = 'moon' AND relevance >= 0.1 {_TOP} 50",
    "star_max_recall": _RECALL + " SELECT * FROM star",
    "star_counts": _STAR + " SELECT count(*) FILTER (kind = 'planet') AS planets, count(*) FILTER (kind = 'moon') AS moons, count(*) AS results FROM star",
    "star_token_budget": _BUDGET + " SELECT * FROM budget",
    "star_package": _BUDGET + " SELECT count(*) FILTER (kind = 'planet') AS planets, count(*) FILTER (kind = 'moon') AS moons, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens_used, CAST(8192 AS BIGINT) AS budget_limit, round(coalesce(sum(tokens), 0) / 8192, 9) AS utilization FROM budget",
    "star_paths": _STAR + _PATHS + " SELECT s.atom_id, s.hop, array_to_string(CASE WHEN s.hop = 0 THEN pt.path ELSE pm.path END, ' ') AS path FROM star s LEFT JOIN pt ON pt.atom_id = s.atom_id LEFT JOIN pm ON pm.atom_id = s.atom_id",
    "star_by_time": _STAR + " SELECT atom_id, relevance, row_number() OVER (ORDER BY ts, atom_id) AS position FROM star JOIN atoms USING (atom_id)",
    "star_raw_text": _star(_RAW.replace(_CTE["planet"], "SELECT atom_id, 1 AS shared, 0 AS hop FROM seeds")) + " SELECT * FROM star",
    "star_deduplicated": _RECALL + f""", w AS (SELECT s.atom_id, s.relevance, d.source, s.atom_id * 400 AS a, s.atom_id * 400 + length(d.text) AS b, d.text, p.simhash FROM star s JOIN documents d ON d.doc_id = s.atom_id JOIN prints p ON p.doc_id = s.atom_id)
      SELECT atom_id, relevance FROM w WHERE NOT EXISTS (SELECT 1 FROM w o WHERE (o.relevance > w.relevance OR (o.relevance = w.relevance AND o.atom_id < w.atom_id)) AND (
        md5(substr(o.text, 1, 500)) = md5(substr(w.text, 1, 500)) OR contains(o.text, w.text) OR (length(o.text) >= 80 AND length(w.text) >= 80 AND levenshtein(substr(o.text, 1, 80), substr(w.text, 1, 80)) <= 8)
        OR (o.source = w.source AND least(o.b, w.b) - greatest(o.a, w.a) > 0 AND least(o.b, w.b) - greatest(o.a, w.a) >= 0.5 * least(o.b - o.a, w.b - w.a)) OR bit_count(xor(o.simhash, w.simhash)) < 5))""",
    "last_user_query": "SELECT conv_id, coalesce(arg_max(text, turn), 'general query') AS query FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "chat_context": _found(0.00001, 0.85, 1) + f", b AS (SELECT * FROM f WHERE kind = 'planet' AND relevance >= 0.1 {_TOP} 5) SELECT atom_id, '[' || atom_id || '] ' || substr(text, 1, 200) AS context FROM b JOIN documents ON doc_id = atom_id",
    "illuminate_d1": _illuminate(1),
    "illuminate_d2": _illuminate(2),
    "illuminate_summary": _with("h2") + """, a AS (SELECT (SELECT count(*) FROM seeds) AS n0, (SELECT count(*) FROM h1) AS n1, (SELECT count(*) FROM h2) AS n2),
      e AS (SELECT CASE WHEN n0 + n1 >= 300 OR n1 = 0 THEN n0 + n1 ELSE n0 + n1 + n2 END AS explored, n0, n1 FROM a)
      SELECT CAST(least(explored, 300) AS BIGINT) AS total, CAST(explored AS BIGINT) AS nodes_explored, CAST(CASE WHEN least(explored, 300) > n0 + n1 THEN 2 WHEN least(explored, 300) > n0 THEN 1 ELSE 0 END AS BIGINT) AS deepest FROM e""",
    "rake_phrases": f"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}\\s]+|\\n')) AS part FROM documents),
      w AS (SELECT doc_id, unnest(string_split(array_to_string(list_transform(regexp_split_to_array(trim(part, ' '), '\\s+'), lambda x: CASE WHEN x IN ({_STOP}) THEN '|' ELSE x END), ' '), '|')) AS part FROM p),
      s AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(part, ' '), '\\s+'), lambda x: length(x) >= 2) AS ws FROM w),
      r AS (SELECT doc_id, ws, count(*) AS n FROM s WHERE len(ws) BETWEEN 1 AND 4 GROUP BY doc_id, ws),
      e AS (SELECT doc_id, ws, n, unnest(ws) AS x FROM r), f AS (SELECT doc_id, x, sum(len(ws) * n) / sum(n) AS s FROM e GROUP BY doc_id, x),
      t AS (SELECT e.doc_id, array_to_string(e.ws, ' ') AS phrase, round(sum(f.s), 9) AS score FROM e JOIN f USING (doc_id, x) GROUP BY e.doc_id, e.ws),
      k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS rank FROM t) SELECT * FROM k WHERE rank <= 10""",
    "ingest_talks": "WITH a AS (" + _atomize(f"SELECT conv_id, {_clean('text')} AS text FROM ({_CTE['talk']})", "conv_id", r"\n\n+", ", content") + f"""),
      k AS (SELECT conv_id, seq, unnest(regexp_extract_all(lower(content), '{_TOK}')) AS term FROM a), n AS (SELECT conv_id, seq, term, count(*) AS n FROM k WHERE term NOT IN ({_STOP}) GROUP BY 1, 2, 3),
      r AS (SELECT *, n / max(n) OVER (PARTITION BY conv_id, seq) AS score, row_number() OVER (PARTITION BY conv_id, seq ORDER BY n DESC, term) AS rank FROM n),
      t AS (SELECT conv_id, seq, '#' || term AS tag FROM r WHERE rank <= 10 AND score >= 0.3 UNION SELECT conv_id, seq, '#' || lower(unnest(regexp_extract_all(content, '#([\\p{{L}}\\p{{N}}_]+)', 1))) FROM a)
      SELECT CAST(conv_id AS VARCHAR) AS source_id, a.seq, char_start, char_end, (SELECT count(*) FROM t WHERE t.conv_id = a.conv_id AND t.seq = a.seq) AS n_tags FROM a""",
    "distill_blocks": _with("uni") + "SELECT atom_id, source, CAST(hop AS BIGINT) AS hop, round(pow(0.85, hop), 9) AS gravity, CAST(length(text) AS BIGINT) AS chars FROM uni",
    "distill_records": _with("uni") + "SELECT source, md5(string_agg(text, chr(10) ORDER BY atom_id) || chr(10)) AS content, count(*) AS blocks, CAST(max(hop) AS BIGINT) AS total_hops FROM uni GROUP BY source",
    "distill_summary": _with("uni") + f", b AS (SELECT CAST(sum({_WORDS}) AS BIGINT) AS words_before, count(*) AS atoms FROM met), a AS (SELECT CAST(sum({_WORDS}) AS BIGINT) AS words_after, count(*) AS unique_atoms FROM uni) SELECT *, round(words_after / words_before, 9) AS compression_ratio FROM b, a",
    "order_part_pairs": "WITH li AS (" + _CTE["li"] + ") SELECT a.p AS a, b.p AS b, count(*) AS n FROM li a JOIN li b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 2",
    "order_part_walk": "WITH li AS (" + _CTE["li"] + """), a AS (SELECT DISTINCT o FROM li WHERE p IN (SELECT p FROM li WHERE o = 1) AND o <> 1), b AS (SELECT DISTINCT o FROM li WHERE p IN (SELECT p FROM li WHERE o IN (SELECT o FROM a)) AND o <> 1 AND o NOT IN (SELECT o FROM a))
      SELECT CAST(1 AS BIGINT) AS atom_id, CAST(0 AS BIGINT) AS hop UNION ALL SELECT o, 1 FROM a UNION ALL SELECT o, 2 FROM b""",
    "tag_cooccurrence": _with("cooc") + "SELECT * FROM cooc",
    "tag_jaccard": _with("jacc") + "SELECT * FROM jacc",
    "simhash_synonyms": _with("fpsyn") + "SELECT * FROM fpsyn",
    "synonym_union": _with("rings") + "SELECT tag, array_to_string(synonyms, ' ') AS synonyms FROM rings",
    "synonym_top20": _with("rings") + "SELECT tag, CAST(len(synonyms) AS BIGINT) AS size FROM rings ORDER BY 2 DESC, 1 LIMIT 20",
    "path_columns": _with("path") + "SELECT page_id, CASE WHEN len(string_split(path, '/')) > 1 THEN string_split(path, '/')[-2] ELSE 'default' END AS bucket, 'src_' || replace(replace(path, '/', '_'), chr(92), '_') AS inline_id, sha256(path) || '.md' AS mirror FROM path",
    "ignore_paths": _with("path") + "SELECT page_id, ends_with(string_split(path, '/')[-1], '5') OR len(list_filter(string_split(path, '/'), lambda x: contains(x, 'm.th') OR contains(x, 'target'))) > 0 AS ignored FROM path",
    "repo_url_parse": """WITH r AS (SELECT page_id, page_id % 7 <> 0 AS ok, CASE WHEN page_id % 3 = 0 THEN 'main' END AS b FROM pages)
      SELECT page_id, CASE WHEN ok THEN 'o' || page_id END AS owner, CASE WHEN ok THEN b END AS ref, CASE WHEN ok THEN 'https://api.github.com/repos/o' || page_id || '/r.x/tarball' || coalesce('/' || b, '') END AS tarball, CASE WHEN ok THEN 'o' || page_id || '-r.x' END AS folder FROM r""",
    "due_repositories": "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 5 = 0 OR (epoch_us(TIMESTAMP '1998-01-01') - epoch_us(CAST(o_orderdate AS TIMESTAMP))) / 1e6 >= o_orderkey * 100000)",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
