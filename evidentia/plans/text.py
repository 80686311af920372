"""Queries of text structure."""

from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import text as X
from ..operators.dictionary import frequent
from .registry import Tables, query

_LINES = """raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
 li AS (SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, raw FROM raw),
 lines AS (SELECT doc_id, line, start, start + length(raw) AS "end", CAST(length(raw) - length(ltrim(raw, ' ')) AS INTEGER) AS indent, trim(raw, ' ') AS body FROM li)"""
#: every line is an entry of depth 1 + line mod 3
_ENTRIES = """en AS (SELECT doc_id, line AS id, start, 1 + line % 3 AS depth, "end" AS line_end, max("end") OVER (PARTITION BY doc_id) AS text_end FROM lines)"""
_OUTLINE = """ol AS (SELECT e.*, coalesce((SELECT min(n.start) FROM en n WHERE n.doc_id = e.doc_id AND n.start > e.start AND n.depth <= e.depth), text_end) AS "end", (SELECT arg_max(n.id, n.start) FROM en n WHERE n.doc_id = e.doc_id AND n.start < e.start AND n.depth < e.depth) AS parent FROM en e)"""


def entries(t: Tables):
    e = X.lines(t("documents")).selectExpr("doc_id", "line id", "start", "1 + line % 3 depth", "end line_end")
    from pyspark.sql import Window

    return e.withColumn("text_end", F.max("line_end").over(Window.partitionBy("doc_id")))


@query("t1_lines", f"WITH {_LINES} SELECT * FROM lines")
def t1(t: Tables):
    return X.lines(t("documents"))


@query("t2_section_chunks", """SELECT doc_id, true AS lossless, true AS bounded FROM documents WHERE length(text) > 0""")
def t2(t: Tables):
    """Whether chunks cover each text without gaps and keep to the limit: the invariant of the chunking."""
    from pyspark.sql import Window

    heads = entries(t).where("id % 5 = 0 and start > 0").selectExpr("doc_id", "start", "depth")
    c = X.section_chunks(t("documents"), heads, 1500)
    before = F.coalesce(F.lag("end").over(Window.partitionBy("doc_id").orderBy("start")), F.lit(0))
    c = c.withColumn("gapless", F.col("start") == before).join(t("documents").selectExpr("doc_id", "length(text) n"), "doc_id")
    return c.groupBy("doc_id").agg((F.min("gapless") & (F.max("end") == F.max("n"))).alias("lossless"), F.min(F.col("end") - F.col("start") <= 1500).alias("bounded"))


@query("t2_section_cuts", f"""WITH RECURSIVE {_LINES}, {_ENTRIES},
 marks AS (SELECT doc_id, start AS p, CASE WHEN depth <= 2 THEN 0 ELSE 1 END AS kind FROM en WHERE id % 5 = 0 AND start > 0 UNION ALL SELECT doc_id, start, 2 FROM lines WHERE start > 0),
 own AS (SELECT doc_id, coalesce(list(p) FILTER (kind = 0), []) AS a, coalesce(list(p) FILTER (kind = 1), []) AS b, coalesce(list(p) FILTER (kind = 2), []) AS c FROM marks GROUP BY doc_id),
 w AS (SELECT d.doc_id, length(text) AS n, coalesce(a, []) AS a, coalesce(b, []) AS b, coalesce(c, []) AS c, CAST(0 AS BIGINT) AS prior, CAST(0 AS BIGINT) AS pos FROM documents d LEFT JOIN own ON own.doc_id = d.doc_id WHERE length(text) > 0
  UNION ALL SELECT doc_id, n, a, b, c, pos, CAST(coalesce(list_min(list_filter(a, lambda p: p > pos AND p <= least(n, pos + 1500))), CASE WHEN n <= pos + 1500 THEN n END,
   list_max(list_filter(b, lambda p: p > pos + 750 AND p <= pos + 1500)), list_max(list_filter(c, lambda p: p > pos + 750 AND p <= pos + 1500)), pos + 1500) AS BIGINT) FROM w WHERE pos < n)
 SELECT doc_id, CAST(prior AS INTEGER) AS start, CAST(pos AS INTEGER) AS "end" FROM w WHERE pos > 0""")
def t2_cuts(t: Tables):
    """The cuts themselves: every fifth line is a heading."""
    return X.section_chunks(t("documents"), entries(t).where("id % 5 = 0 and start > 0").selectExpr("doc_id", "start", "depth"), 1500)


#: tokens with their places, whether a token ends a sentence or paragraph, and the last such end of every possible window
@query("t3_token_chunks", r"""WITH RECURSIVE ps AS (SELECT doc_id, length(text) AS n_chars, regexp_extract_all(text, '[\p{L}\p{N}_]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|.') AS l FROM documents),
 pc AS (SELECT doc_id, n_chars, unnest(l) AS piece, generate_subscripts(l, 1) AS o FROM ps),
 pl AS (SELECT *, coalesce(sum(length(piece)) OVER w, 0) AS start, lead(piece) OVER (PARTITION BY doc_id ORDER BY o) AS after FROM pc WINDOW w AS (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 gp AS (SELECT *, CASE WHEN regexp_full_match(after, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+') THEN after ELSE '' END AS gap FROM pl WHERE NOT regexp_full_match(piece, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+')),
 tk AS (SELECT doc_id, n_chars, start, start + length(piece) AS stop, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, lag(contains(gap, chr(10)) OR (piece IN ('.', '!', '?') AND trim(gap, ' ') = ''), 1, false) OVER o AS good FROM gp WINDOW o AS (PARTITION BY doc_id ORDER BY start)),
 jump AS (SELECT *, CASE WHEN i + 192 >= n THEN n ELSE coalesce(max(CASE WHEN good THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 96 FOLLOWING AND 191 FOLLOWING), i + 192) END AS upto FROM tk),
 w AS (SELECT doc_id, 0 AS idx, i, upto, n FROM jump WHERE i = 0 UNION ALL SELECT j.doc_id, w.idx + 1, j.i, j.upto, j.n FROM w JOIN jump j ON j.doc_id = w.doc_id AND j.i = greatest(w.i + 1, w.upto - 32) WHERE w.upto < w.n)
 SELECT w.doc_id, CAST(idx AS INTEGER) AS idx, CAST(CASE WHEN idx = 0 THEN 0 ELSE a.start END AS INTEGER) AS start, CAST(CASE WHEN w.upto = w.n THEN a.n_chars ELSE b.stop END AS INTEGER) AS "end" FROM w JOIN jump a ON a.doc_id = w.doc_id AND a.i = w.i JOIN jump b ON b.doc_id = w.doc_id AND b.i = w.upto - 1
 UNION ALL SELECT d.doc_id, 0, 0, CAST(length(text) AS INTEGER) FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM tk) k ON k.doc_id = d.doc_id WHERE k.doc_id IS NULL AND length(text) > 0""")
def t3(t: Tables):
    return X.token_chunks(t("documents"))


_CHUNKS = 'ch AS (SELECT doc_id, CAST(i AS INTEGER) AS idx, i * 400 AS start, least(i * 400 + 450, length(text)) AS "end", text FROM (SELECT *, unnest(range(0, greatest(1, (length(text) + 349) // 400))) AS i FROM documents WHERE length(text) > 0))'


def chunks(t: Tables):
    c = t("documents").where("length(text) > 0").selectExpr("doc_id", "text", "length(text) n", "explode(sequence(0L, greatest(1L, (length(text) + 349) div 400) - 1)) i")
    return c.selectExpr("doc_id", "cast(i as int) idx", "i * 400 start", "least(i * 400 + 450, n) end", "text")


@query("t4_audit_chunks", f"""WITH {_CHUNKS}, b AS (SELECT *, CASE WHEN doc_id % 4 = 0 AND idx = 1 THEN start + 100 ELSE start END AS s FROM ch), w AS (SELECT *, lag("end") OVER o AS before, lag(s) OVER o AS prior, lead(idx) OVER o IS NULL AS last FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY idx))
 SELECT doc_id, idx, v AS violation FROM (SELECT doc_id, idx, CASE WHEN before IS NULL AND s <> 0 THEN 'start' WHEN s > before THEN 'gap' WHEN s <= prior THEN 'no_advance' WHEN last AND "end" <> length(text) THEN 'end' WHEN doc_id % 5 = 0 THEN 'hash' END AS v FROM w) WHERE v IS NOT NULL""")
def t4(t: Tables):
    c = chunks(t).withColumn("start", F.when((F.col("doc_id") % 4 == 0) & (F.col("idx") == 1), F.col("start") + 100).otherwise(F.col("start")))
    c = c.withColumn("sha", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.sha2(F.expr("substring(text, cast(start as int) + 1, cast(end - start as int))"), 256)))
    return X.audit_chunks(c.drop("text"), t("documents"))


@query("t5_sentence_spans", r"""WITH l AS (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+') AS l FROM documents), pc AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM l),
 pl AS (SELECT *, coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM pc), ct AS (SELECT doc_id, base, raw, unnest(range(0, length(raw), 320)) AS o FROM pl),
 pe AS (SELECT doc_id, base + o AS base, substring(raw, o + 1, 320) AS piece FROM ct), st AS (SELECT doc_id, base + length(piece) - length(ltrim(piece, e' \t\r\n')) AS start, length(trim(piece, e' \t\r\n')) AS n FROM pe)
 SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS "end" FROM st WHERE n > 0""")
def t5(t: Tables):
    return X.sentence_spans(t("documents"))


@query("t6_headings", f"""WITH {_LINES} SELECT doc_id, line, start, 'capital' AS kind, regexp_extract(body, '^([A-Z][a-z]+) (\\w+)', 1) AS identifier, regexp_extract(body, '^([A-Z][a-z]+) (\\w+)', 2) AS title, 1 AS depth FROM lines WHERE regexp_matches(body, '^([A-Z][a-z]+) (\\w+)') AND NOT regexp_matches(body, '^([A-Z][A-Z]+)()')""")
def t6(t: Tables):
    return X.headings(X.lines(t("documents")).where(~F.col("body").rlike("^([A-Z][A-Z]+)()")), [("capital", r"^([A-Z][a-z]+) (\w+)", 1)])


@query("t7_close_spans", f'WITH {_LINES}, {_ENTRIES}, {_OUTLINE} SELECT doc_id, id, start, "end", depth, parent FROM ol')
def t7(t: Tables):
    return X.close_spans(entries(t).drop("line_end"))


@query("t8_subitems", f"""WITH RECURSIVE {_LINES}, it AS (SELECT doc_id, CAST(line // 8 AS VARCHAR) AS base, CAST(line AS BIGINT) AS seq, CAST(line % 8 AS VARCHAR) AS marker, 1 + (line * 5) % 4 AS level, row_number() OVER (PARTITION BY doc_id, line // 8 ORDER BY line) AS n FROM lines),
 w AS (SELECT doc_id, base, seq, n, [marker] AS path, level > 1 AS jumped FROM it WHERE n = 1
  UNION ALL SELECT it.doc_id, it.base, it.seq, it.n, list_append(w.path[1:least(it.level, len(w.path) + 1) - 1], it.marker), it.level > len(w.path) + 1 FROM w JOIN it ON it.doc_id = w.doc_id AND it.base = w.base AND it.n = w.n + 1)
 SELECT doc_id, base, seq, base || '.' || array_to_string(path, '.') AS identifier, jumped FROM w""")
def t8(t: Tables):
    rows = X.lines(t("documents")).selectExpr("doc_id", "cast(line div 8 as string) base", "cast(line as bigint) seq", "cast(line % 8 as string) marker", "1 + line * 5 % 4 level")
    return X.subitems(rows)


@query("t9_flag_duplicate_ids", f"WITH {_LINES} SELECT doc_id, line, count(*) OVER (PARTITION BY doc_id, lower(substring(body, 1, 2))) > 1 AS malformed FROM lines WHERE regexp_matches(body, '^[A-Za-z][A-Za-z]')")
def t9(t: Tables):
    rows = X.lines(t("documents")).where(F.col("body").rlike("^[A-Za-z][A-Za-z]")).selectExpr("doc_id", "line", "substring(body, 1, 2) identifier")
    return X.flag_duplicate_ids(rows).select("doc_id", "line", "malformed")


@query("t12_scopes", f"""WITH {_LINES}, m AS (SELECT *, max("end") OVER (PARTITION BY doc_id) AS stop FROM lines), o AS (SELECT * FROM m WHERE line = 0 OR starts_with(body, 'T'))
 SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS scope, start, coalesce(lead(start) OVER w, stop) AS "end" FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY line)""")
def t12(t: Tables):
    return X.scopes(X.lines(t("documents")), F.startswith("body", F.lit("T")))


_WORDS = """pt AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+')) AS part, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+'), 1) AS i FROM documents),
 pl AS (SELECT *, CAST(coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM pt),
 wd AS MATERIALIZED (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS n, start, start + length(part) AS "end", lower(part) AS word FROM pl WHERE regexp_matches(part, '^[A-Za-z0-9]+$'))"""


@query("t33_token_table", f"WITH {_WORDS} SELECT * FROM wd")
def t33(t: Tables):
    return X.word_table(t("documents"))


@query("t33_align_spans", f"""WITH {_WORDS}, ws AS MATERIALIZED (SELECT doc_id * 100000000 + start AS k, n FROM wd), we AS MATERIALIZED (SELECT doc_id * 100000000 + "end" AS k, n FROM wd),
 sp AS MATERIALIZED (SELECT doc_id, n AS id, doc_id * 100000000 + start + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS ks, doc_id * 100000000 + "end" AS ke FROM wd WHERE n % 10 = 0),
 f AS MATERIALIZED (SELECT sp.*, ws.n AS first FROM sp LEFT JOIN ws ON ws.k = sp.ks)
 SELECT doc_id, id, first, we.n AS last, first IS NOT NULL AND we.n IS NOT NULL AS aligned FROM f LEFT JOIN we ON we.k = f.ke""")
def t33a(t: Tables):
    w = X.word_table(t("documents"))
    return X.align_spans(w.where("n % 10 = 0").selectExpr("doc_id", "n id", "start + if(n % 3 = 0, 1, 0) start", "end"), t("documents"))


#: a dictionary of the words and word pairs that most documents have
_TERMS = f"""tm AS (SELECT word AS surface, row_number() OVER (ORDER BY c DESC, word) AS term_id FROM (SELECT word, count(*) AS c FROM (SELECT word FROM wd WHERE length(word) > 2 UNION ALL SELECT word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY n) FROM wd) z WHERE word IS NOT NULL GROUP BY word) QUALIFY term_id BETWEEN 20 AND 120)"""
_BOUND = """bd AS (SELECT doc_id, term_id, start, "end" FROM wd JOIN tm ON surface = word UNION ALL SELECT doc_id, term_id, start, e2 FROM (SELECT *, word || ' ' || lead(word) OVER o AS two, lead("end") OVER o AS e2 FROM wd WINDOW o AS (PARTITION BY doc_id ORDER BY n)) JOIN tm ON surface = two)"""


def terms(t: Tables):
    from pyspark.sql import Window

    first = frequent(t("documents"), 120)
    return first.withColumn("term_id", F.row_number().over(Window.orderBy(F.desc("c"), "surface")).cast("long")).where("term_id >= 20").select("term_id", "surface")


@query("t13_bind_terms", f"WITH {_WORDS}, {_TERMS}, {_BOUND} SELECT doc_id, term_id, start, \"end\" FROM bd")
def t13(t: Tables):
    return X.bind_terms(t("documents"), terms(t))


@query("t13_bind_scoped", f"WITH {_WORDS}, {_TERMS}, {_BOUND} SELECT doc_id, term_id, start, \"end\" FROM bd WHERE (term_id + doc_id) % 3 = 0 AND start >= doc_id % 90 AND \"end\" <= 100 * term_id")
def t13_scoped(t: Tables):
    """Every document defines a third of the terms, each for a span of its own."""
    d = t("documents")
    own = d.select("doc_id").join(F.broadcast(terms(t)), (F.col("term_id") + F.col("doc_id")) % 3 == 0)
    return X.bind_terms(d, own.selectExpr("doc_id", "term_id", "surface", "doc_id % 90 scope_start", "100 * term_id scope_end"))


@query("t29_link_entities", f"""WITH {_WORDS}, {_TERMS}, tm2 AS (SELECT surface, term_id % 60 AS term_id FROM tm UNION ALL SELECT surface, 1000 FROM tm WHERE term_id % 9 = 0), {_BOUND.replace('JOIN tm ON', 'JOIN tm2 AS tm ON')},
 s AS (SELECT doc_id, start, "end", count(DISTINCT term_id) AS n, min(term_id) AS identity FROM bd GROUP BY ALL),
 c AS (SELECT DISTINCT s.doc_id, s.start, s."end" FROM s JOIN s b ON s.doc_id = b.doc_id AND s.start < b."end" AND s."end" > b.start AND b."end" - b.start > s."end" - s.start)
 SELECT s.doc_id, s.start, s."end", CASE WHEN c.doc_id IS NOT NULL THEN 'overlapped' WHEN n > 1 THEN 'ambiguous' ELSE 'linked' END AS status, CASE WHEN c.doc_id IS NULL AND n = 1 THEN identity END AS identity FROM s LEFT JOIN c ON c.doc_id = s.doc_id AND c.start = s.start AND c."end" = s."end" """)
def t29(t: Tables):
    r = terms(t)
    registry = r.selectExpr("term_id % 60 identity", "surface").unionByName(r.where("term_id % 9 = 0").selectExpr("1000L identity", "surface"))
    return X.link_entities(t("documents"), registry)


@query("t31_best_excerpt", f"""WITH {_WORDS}, {_TERMS}, h AS (SELECT doc_id, term_id, start, "end" FROM wd JOIN tm ON surface = word), n AS (SELECT a.doc_id, a.start AS w, count(DISTINCT b.term_id) AS terms, count(*) AS hits FROM (SELECT DISTINCT doc_id, start FROM h) a JOIN h b ON a.doc_id = b.doc_id AND b.start >= a.start AND b."end" <= a.start + 300 GROUP BY ALL)
 SELECT doc_id, w AS start, terms, hits FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY terms DESC, hits DESC, w) = 1""")
def t31(t: Tables):
    return X.best_excerpt(t("documents"), terms(t), 300)


#: every document gets a clause on precedence and one that overrides another; offsets follow from the lengths of their parts
_ORDER = ["Order of precedence\nIn any conflict the documents rank in the following order:\n", "(a) Deed ", ";  and\n", "(b) the Schedules,\n", "(c) all\nothers.\n", "Price\n Notwithstanding clause ", " the Price holds.\n"]


@query("t14_precedence_edges", """WITH d AS (SELECT doc_id, length(coalesce(text, '')) + 1 AS base, CAST(doc_id AS VARCHAR) AS n, CAST(doc_id % 7 AS VARCHAR) AS c FROM documents),
 o AS (SELECT doc_id, base, n, c, base + 79 AS a, base + 79 + 9 + length(n) + 7 AS b FROM d), p AS (SELECT *, b + 19 AS c0, b + 35 AS q FROM o)
 SELECT doc_id, 'precedes' AS kind, 'order' AS source, 'Deed ' || n AS higher, 'the Schedules' AS lower, NULL::VARCHAR AS target, NULL::VARCHAR AS target_outcome, a AS start, c0 AS "end" FROM p
 UNION ALL SELECT doc_id, 'precedes', 'order', 'the Schedules', 'all others', NULL, NULL, b, q FROM p
 UNION ALL SELECT doc_id, 'notwithstanding', 'price', NULL, NULL, c, CASE WHEN doc_id % 7 IN (1, 2) THEN 'resolved' ELSE 'unresolved_absent' END, q + 7, q + 30 + length(c) FROM p""")
def t14(t: Tables):
    n, c = F.col("doc_id").cast("string"), (F.col("doc_id") % 7).cast("string")
    parts = [F.lit(_ORDER[0]), F.concat(F.lit(_ORDER[1]), n, F.lit(_ORDER[2])), F.lit(_ORDER[3]), F.lit(_ORDER[4]), F.concat(F.lit(_ORDER[5]), c, F.lit(_ORDER[6]))]
    text = F.coalesce("text", F.lit(""))
    docs = t("documents").select("doc_id", F.concat(text, F.lit("\n"), *parts).alias("text"), (F.length(text) + 1).alias("base"))
    starts = [sum((F.length(x) for x in parts[:i]), F.col("base")) for i in range(6)]
    entry = lambda id_, parent, kind, title, identifier, start, end: F.struct(F.lit(id_).alias("id"), F.lit(parent).cast("string").alias("parent"), F.lit(kind).alias("kind"), F.lit(title).alias("title"), F.lit(identifier).alias("identifier"), F.lit(f"({id_})").alias("display"), F.lit(True).alias("valid"), start.cast("long").alias("start"), end.cast("long").alias("end"))
    rows = F.array(entry("order", None, "clause", "Order of Precedence", "1", starts[0], starts[4]), *[entry(x, "order", "subclause", "", f"1({x})", starts[i + 1], starts[i + 2]) for i, x in enumerate("abc")], entry("price", None, "clause", "Price", "2", starts[4], starts[5]))
    return X.precedence_edges(docs, docs.select("doc_id", F.inline(rows)))


@query("t15_chunk_provenance", f"""WITH {_LINES}, {_CHUNKS}, s AS (SELECT doc_id, line AS id, start, "end", CASE line % 3 WHEN 0 THEN 'reference' WHEN 1 THEN 'edge' ELSE 'clause' END AS kind FROM lines WHERE "end" > start)
 SELECT ch.doc_id, ch.idx AS id, kind, count(*) AS spans, min(s.id) AS first_span FROM ch JOIN s ON ch.doc_id = s.doc_id AND ch.start < s."end" AND ch."end" > s.start GROUP BY ALL""")
def t15(t: Tables):
    spans = X.lines(t("documents")).where("end > start").selectExpr("doc_id", "line id", "start", "end", "case line % 3 when 0 then 'reference' when 1 then 'edge' else 'clause' end kind")
    return X.chunk_provenance(chunks(t).selectExpr("doc_id", "idx id", "start", "end"), spans)


@query("t16_enclosing_unit", f"""WITH {_LINES}, {_ENTRIES}, {_OUTLINE}, {_CHUNKS}, j AS (SELECT ch.doc_id, idx AS id, ol.id AS unit, row_number() OVER (PARTITION BY ch.doc_id, idx ORDER BY ol."end" - ol.start, ol.start, ol.id) AS r FROM ch JOIN ol ON ch.doc_id = ol.doc_id AND ch.start >= ol.start AND ch.start < ol."end") SELECT doc_id, id, unit FROM j WHERE r = 1""")
def t16(t: Tables):
    units = X.close_spans(entries(t).drop("line_end"))
    return X.enclosing_unit(chunks(t).selectExpr("doc_id", "idx id", "start at"), units.select("doc_id", "id", "start", "end")).selectExpr("doc_id", "id", "b_id unit")


#: outline entries of depth 1 are clauses; every fourth line holds a duty; every line is a position
@query("t17_composite_units", f"""WITH RECURSIVE {_LINES}, {_ENTRIES}, {_OUTLINE}, fr AS (SELECT doc_id, start, "end" AS stop FROM lines WHERE line % 4 = 0),
 ch AS (SELECT doc_id, parent AS id, min(start) AS child FROM ol WHERE parent IS NOT NULL GROUP BY ALL),
 k AS (SELECT ol.doc_id, ol.id, ol.parent, ol.start, ol."end", depth = 1 AS clause, ol.id % 11 <> 0 AS valid, coalesce(child, ol."end") AS lead_end, (SELECT arg_min(stop, fr.start) FROM fr WHERE fr.doc_id = ol.doc_id AND fr.start >= ol.start) AS duty FROM ol LEFT JOIN ch ON ch.doc_id = ol.doc_id AND ch.id = ol.id),
 x AS (SELECT k.*, p.id AS pid, p.start AS ps, p."end" AS pe, p.lead_end AS pl, coalesce(p.start < p.lead_end AND p.lead_end <= k.start, false) AS has_lead, coalesce(p.start < p.lead_end AND p.lead_end <= k.start AND p.duty <= p.lead_end, false) AS lead_duty FROM k LEFT JOIN k p ON p.doc_id = k.doc_id AND p.id = k.parent AND NOT k.clause),
 inn AS (SELECT l.doc_id, l.line AS point, l.start AS at_, k.id FROM lines l JOIN k ON k.doc_id = l.doc_id AND k.valid AND k.start <= l.start AND l.start < k."end" QUALIFY row_number() OVER (PARTITION BY l.doc_id, l.line ORDER BY k."end" - k.start, k.start, k.id) = 1),
 w AS (SELECT doc_id, point, at_, id AS rel, id AS cur, []::STRUCT(s BIGINT, e BIGINT, r VARCHAR, i INTEGER)[] AS leads FROM inn
  UNION ALL SELECT w.doc_id, point, at_, rel, x.pid, CASE WHEN has_lead THEN list_append(leads, {{'s': ps, 'e': pl, 'r': 'lead', 'i': pid}}) ELSE leads END FROM w JOIN x ON x.doc_id = w.doc_id AND x.id = cur WHERE pid IS NOT NULL AND NOT lead_duty AND NOT coalesce(duty <= least("end", at_ + 400), false)),
 f AS (SELECT w.doc_id, point, rel, x.*, CASE WHEN has_lead THEN list_append(leads, {{'s': ps, 'e': pl, 'r': 'lead', 'i': pid}}) ELSE leads END AS ls FROM w JOIN x ON x.doc_id = w.doc_id AND x.id = cur WHERE pid IS NULL OR lead_duty OR coalesce(duty <= least("end", at_ + 400), false)),
 g AS (SELECT f.doc_id, f.point, f.rel, CASE WHEN pid IS NULL THEN 'own' WHEN lead_duty THEN CASE WHEN pe - ps <= 2400 THEN 'parent' ELSE 'segments' END WHEN len(ls) > 0 THEN 'segments' ELSE 'own' END AS as_, f.id, f.start, f."end", pid, ps, pe, ls, r.start AS rs, r."end" AS re FROM f JOIN k r ON r.doc_id = f.doc_id AND r.id = f.rel),
 s AS (SELECT *, CASE as_ WHEN 'own' THEN [{{'s': start, 'e': "end", 'r': 'own', 'i': id}}] WHEN 'parent' THEN [{{'s': ps, 'e': pe, 'r': 'parent', 'i': pid}}] ELSE list_sort(list_append(ls, {{'s': rs, 'e': re, 'r': 'relation', 'i': rel}})) END AS seg FROM g)
 SELECT doc_id, point, rel AS relation, CASE as_ WHEN 'own' THEN id WHEN 'parent' THEN pid ELSE rel END AS unit, CASE as_ WHEN 'own' THEN start WHEN 'parent' THEN ps ELSE rs END AS start, CASE as_ WHEN 'own' THEN "end" WHEN 'parent' THEN pe ELSE re END AS "end",
  CAST(list_sum(list_transform(seg, lambda q: q.e - q.s)) + 2 * len(seg) - 2 AS BIGINT) AS chars, array_to_string(list_transform(seg, lambda q: q.s || '-' || q.e || ' ' || q.r || ' ' || q.i), ';') AS segments, list_sum(list_transform(seg, lambda q: q.e - q.s)) + 2 * len(seg) - 2 > 2400 AS oversize FROM s""")
def t17(t: Tables):
    lines = X.lines(t("documents"))
    outline = X.close_spans(entries(t).drop("line_end")).selectExpr("doc_id", "id", "parent", "if(depth = 1, 'clause', 'subclause') kind", "id % 11 <> 0 valid", "start", "end")
    out = X.composite_units(lines.selectExpr("doc_id", "line point", "start at"), outline, lines.where("line % 4 = 0").select("doc_id", "start", "end"))
    return out.withColumn("segments", F.array_join(F.transform("segments", lambda s: F.concat_ws(" ", F.concat_ws("-", s["start"], s["end"]), s["role"], s["entry"])), ";"))


@query("t18_inventory", f"WITH {_LINES} SELECT doc_id, count(*) AS entries, CAST(sum((line % 3 = 0)::INT) AS BIGINT) AS a, CAST(sum((line % 3 = 1)::INT) AS BIGINT) AS b, CAST(sum((body = '')::INT) AS BIGINT) AS malformed FROM lines GROUP BY doc_id")
def t18(t: Tables):
    return X.inventory(X.lines(t("documents")).selectExpr("doc_id", "case line % 3 when 0 then 'a' when 1 then 'b' else 'c' end kind", "body = '' malformed"), ["a", "b"])


@query("t19_glossary", """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS spelling FROM w, (SELECT unnest([2, 3, 4]) AS k), LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS i)),
 f AS (SELECT doc_id, spelling, lower(spelling) AS term FROM g WHERE len(list_filter(string_split(lower(spelling), ' '), lambda x: x NOT IN ('the', 'of', 'and', 'to', 'in', 'a', 'is', 'der', 'die', 'und', 'de', 'la', 'le', 'el', 'que'))) > 0),
 s AS (SELECT doc_id, term, spelling, count(*) AS k FROM f GROUP BY ALL), n AS (SELECT *, CAST(sum(k) OVER (PARTITION BY doc_id, term) AS BIGINT) AS n FROM s),
 b AS (SELECT * FROM n WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, term ORDER BY k DESC, spelling) = 1) SELECT doc_id, term, spelling, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS INTEGER) AS rank FROM b QUALIFY rank <= 64""")
def t19(t: Tables):
    return X.glossary(t("documents"))


#: documents with wording that the tables lack, by their number
_CLAUSES = r"""concat(text, case doc_id % 6 when 0 then '\n\nThe Contractor must not commence any construction work under this deed until approved.' when 1 then '\n\nThe parties acknowledge that access is given prior to the start of work; no more.'
 when 2 then '\n\nBefore commencing the work, see clause 2.1, 3(a) and 4; Section 5 of the Water Act 1999 or sections of it.' when 3 then '\n\nThe condition of the site agreed before access to it.' when 4 then '\n\nOn or before the deadline for final completion, give schedules A1 and 2.' else '' end)"""


def clauses(t: Tables):
    return t("documents").select("doc_id", F.expr(_CLAUSES).alias("text"))


def _rule_sql(relation: str, weight: float, pattern: str) -> str:
    p = "'(?is)" + pattern + "'"
    return f"SELECT doc_id, '{relation}' AS relation, {weight}::DOUBLE AS weight, unnest(string_split_regex(text, {p})) AS piece, unnest(regexp_extract_all(text, {p})) AS hit, unnest(range(len(string_split_regex(text, {p})))) AS i FROM d"


_D = "d AS (SELECT doc_id, " + _CLAUSES.replace("'\\n\\n", "chr(10) || chr(10) || '") + " AS text FROM documents)"
_SCAN = f"""{_D}, h AS ({" UNION ALL ".join(_rule_sql(*r) for r in X.RELATION_RULES)}), e AS (SELECT *, CAST(sum(length(piece) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id, relation ORDER BY i) AS BIGINT) AS stop FROM h)
 SELECT doc_id, relation, weight, stop - length(hit) AS start, stop AS "end", CASE WHEN relation IN {X.PROJECT_WIDE} OR regexp_matches(hit, '(?i){X.PROJECT_WIDE_WORDING}') THEN 'project_wide' ELSE 'activity_conditional' END AS conditionality FROM e WHERE hit IS NOT NULL"""


@query("t20_scan_relations", f"WITH {_SCAN}")
def t20(t: Tables):
    return X.scan_relations(clauses(t))


def numbers(t: Tables):
    """An outline entry for each of a few identifiers of every third document."""
    return t("documents").where("doc_id % 3 = 2").selectExpr("doc_id", "stack(4, 1L, '2.1', 40L, false, 2L, '2.1', 10L, false, 3L, '4', 0L, true, 4L, 'Schedule 2', 5L, false) as (id, identifier, start, malformed)")


@query("t10_resolve_references")
def t10(t: Tables):
    return X.resolve_references(clauses(t), numbers(t))


@query("t11_definitions")
def t11(t: Tables):
    d = t("documents").selectExpr("doc_id", r"concat(text, if(doc_id % 4 = 0, '\n\n', ''), '\n\nGoods\nmeans things; and\n\nThe Price includes tax.\n \nend') text")
    whole = d.selectExpr("doc_id", "0L id", "0L start", "cast(length(text) as bigint) end", "if(doc_id % 5 = 0, 'Terms', 'Definitions') title")
    return X.definitions(d, whole, d.selectExpr("doc_id", "0 scope", "0L start", "cast(length(text) as bigint) end"))


@query("t26_cited_clause", """WITH q AS (SELECT conv_id * 1000 + turn AS query_id, CAST(conv_id AS VARCHAR) || '.' || turn AS identifier FROM conversations WHERE turn % 5 <> 4), e AS (SELECT (doc_id // 3) || '.' || (doc_id % 3) AS identifier, doc_id, 0::BIGINT AS start, CAST(length(text) AS BIGINT) AS "end" FROM documents)
 SELECT query_id, q.identifier, doc_id, start, "end" FROM q JOIN e USING (identifier) QUALIFY count(*) OVER (PARTITION BY query_id) = 1""")
def t26(t: Tables):
    q = t("conversations").selectExpr("conv_id * 1000 + turn query_id", "concat('What do ', conv_id, '.', turn, if(turn % 5 = 4, ' and 1', ''), ' say?') question")
    e = t("documents").selectExpr("concat(doc_id div 3, '.', doc_id % 3) identifier", "doc_id", "0L start", "cast(length(text) as bigint) end")
    return X.cited_clause(q, e)


_REL = """rl AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS id, l_returnflag AS relation, CAST(l_partkey % 4 AS DOUBLE) AS weight, l_partkey % 20 AS start, l_partkey % 20 + 2 + l_suppkey % 30 AS "end", l_suppkey % 3 = 0 AS gate FROM lineitem)"""


def relations(t: Tables):
    from ..functions import tokens, numbered

    return numbered(t("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "id").selectExpr("l_orderkey doc_id", "cast(id as bigint) id", "l_returnflag relation", "cast(l_partkey % 4 as double) weight", "l_partkey % 20 start", "l_partkey % 20 + 2 + l_suppkey % 30 end", "l_suppkey % 3 = 0 gate")


@query("t21_resolve_relations", f"""WITH {_REL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start ORDER BY weight DESC, relation, id) AS nth FROM rl)
 SELECT doc_id, id, CASE WHEN nth > 1 THEN 'weaker_at_start' WHEN EXISTS (SELECT 1 FROM n g WHERE g.doc_id = n.doc_id AND g.id <> n.id AND g.gate AND g.nth = 1 AND n.start >= g.start AND n."end" <= g."end" AND n.weight < g.weight) THEN 'inside_gate' ELSE 'kept' END AS status FROM n""")
def t21(t: Tables):
    return X.resolve_relations(relations(t))


@query("t22_exclude_relations")
def t22(t: Tables):
    found = X.scan_relations(clauses(t)).withColumn("id", F.concat_ws(":", "relation", "start"))
    return X.exclude_relations(found, clauses(t))


@query("t23_attribute_actor", f"""WITH {_WORDS}, p AS (SELECT doc_id, n // 30 AS line, n AS at_n, word FROM wd), m AS (SELECT * FROM p WHERE word IN ('of', 'de', 'und')), a AS (SELECT * FROM p WHERE word IN ('the', 'la', 'der')),
 j AS (SELECT m.doc_id, m.line, m.at_n, a.word AS actor, a.at_n < m.at_n AS before, row_number() OVER (PARTITION BY m.doc_id, m.line, m.at_n ORDER BY (a.at_n < m.at_n)::INT DESC, abs(m.at_n - a.at_n), a.word) AS r FROM m JOIN a ON m.doc_id = a.doc_id AND m.line = a.line)
 SELECT doc_id, CAST(line AS BIGINT) AS line, at_n AS "at", actor, before FROM j WHERE r = 1""")
def t23(t: Tables):
    p = X.word_table(t("documents")).selectExpr("doc_id", "n div 30 line", "n at", "word")
    return X.attribute_actor(p.where("word in ('of', 'de', 'und')"), p.where("word in ('the', 'la', 'der')").withColumnRenamed("word", "actor"))


@query("t24_match_motifs", f"""WITH {_WORDS}, e AS (SELECT doc_id, start AS p, word FROM wd WHERE word IN ('the', 'of', 'and')), m AS (SELECT c.doc_id, (SELECT max(a.p) FROM e a WHERE a.doc_id = c.doc_id AND a.word = 'the' AND a.p < (SELECT max(b.p) FROM e b WHERE b.doc_id = c.doc_id AND b.word = 'of' AND b.p < c.p AND EXISTS (SELECT 1 FROM e z WHERE z.doc_id = c.doc_id AND z.word = 'the' AND z.p < b.p))) AS start, c.p AS last_at FROM e c WHERE c.word = 'and')
 SELECT doc_id, 'the-of-and' AS motif, start, last_at, last_at - start AS span FROM m WHERE start IS NOT NULL AND last_at - start <= 800 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY last_at - start, last_at) = 1""")
def t24(t: Tables):
    w = X.word_table(t("documents")).selectExpr("doc_id", "word event", "start at")
    return X.match_motifs(w, "the-of-and", ["the", "of", "and"], 800)


@query("t25_conflict_tags", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'supersed|license') THEN 'supersession' WHEN regexp_matches(lower(text), '\\bthe (of|and)\\b') THEN 'negated' ELSE 'none' END AS tag FROM documents")
def t25(t: Tables):
    return X.conflict_tags(t("documents"), [("supersession", "supersed|license"), ("negated", r"\bthe (of|and)\b")])


@query("t27_query_intent", "SELECT conv_id * 1000 + turn AS query_id, concat_ws(',', CASE WHEN regexp_matches(lower(text), '\\bthe\\b') THEN 'actor' END, CASE WHEN regexp_matches(lower(text), '[0-9]') THEN 'temporal' END, CASE WHEN regexp_matches(lower(text), 'all|every') THEN 'broad' END) AS flags FROM conversations")
def t27(t: Tables):
    q = t("conversations").selectExpr("conv_id * 1000 + turn query_id", "text question")
    return X.query_intent(q, [("actor", r"\bthe\b"), ("temporal", "[0-9]"), ("broad", "all|every")])


@query("t28_quantities", """WITH f AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'size ' || p_size || ' cm' WHEN 1 THEN p_size || 'm and 2 kg' WHEN 2 THEN 'none ' || p_size ELSE p_size || '.5 kg' END AS text FROM part)
 SELECT id, CASE id % 4 WHEN 0 THEN CAST(CAST(regexp_extract(text, '(\\d+) cm', 1) AS DECIMAL(20,6)) * 0.01 AS DECIMAL(30,6)) WHEN 3 THEN CAST(regexp_extract(text, '([0-9.]+) kg', 1) AS DECIMAL(30,6)) END AS amount, CASE id % 4 WHEN 0 THEN 'm' WHEN 3 THEN 'kg' END AS base, CASE id % 4 WHEN 1 THEN 'several' WHEN 2 THEN 'none' ELSE 'ok' END AS reason FROM f""".replace("AS amount", "AS amount_exact").replace("SELECT id, CASE id % 4 WHEN 0 THEN CAST(CAST", "SELECT id, CAST(CASE id % 4 WHEN 0 THEN CAST(CAST").replace("END AS amount_exact", "END AS DOUBLE) AS amount"))
def t28(t: Tables):
    f = t("part").selectExpr("p_partkey id", "case p_partkey % 4 when 0 then concat('size ', p_size, ' cm') when 1 then concat(p_size, 'm and 2 kg') when 2 then concat('none ', p_size) else concat(p_size, '.5 kg') end text")
    units = t.spark.createDataFrame([("cm", "m", "0.01"), ("m", "m", "1"), ("kg", "kg", "1")], "unit string, base string, factor string")
    return X.quantities(f, units).withColumn("amount", F.col("amount").cast("double"))


@query("t30_extract_marked", f"""WITH raw AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'Decision: keep ' || turn || chr(10) || text || chr(10) || '  Constraint: never ' || conv_id ELSE text END AS text FROM conversations)),
 k AS (SELECT *, CASE WHEN starts_with(ltrim(raw, ' '), 'Decision:') THEN 'decision' WHEN starts_with(ltrim(raw, ' '), 'Constraint:') THEN 'constraint' END AS kind, trim(regexp_replace(raw, '^\\s*[^:]+:', ''), ' ') AS body FROM raw), d AS (SELECT *, sha256(conv_id || '|' || turn || '|' || line || '|' || kind || '|' || body) AS g FROM k WHERE kind IS NOT NULL)
 SELECT conv_id, turn, CAST(line AS INTEGER) AS line, kind, body, substring(g, 1, 8) || '-' || substring(g, 9, 4) || '-' || substring(g, 13, 4) || '-' || substring(g, 17, 4) || '-' || substring(g, 21, 12) AS id FROM d""")
def t30(t: Tables):
    c = t("conversations").withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.expr("concat('Decision: keep ', turn, '\n', text, '\n', '  Constraint: never ', conv_id)")).otherwise(F.col("text")))
    return X.extract_marked(c, {"Decision": "decision", "Constraint": "constraint"})


@query("t32_verbatim_overlap", """WITH p AS (SELECT d.doc_id AS pair_id, regexp_extract_all(lower(d.text), '[A-Za-z0-9]+') AS a, regexp_extract_all(lower(e.text), '[A-Za-z0-9]+') AS b FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1),
 h AS (SELECT x.pair_id, x.i, x.i - y.j AS d FROM (SELECT pair_id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM p) x JOIN (SELECT pair_id, unnest(b) AS w, generate_subscripts(b, 1) AS j FROM p) y ON x.pair_id = y.pair_id AND x.w = y.w),
 g AS (SELECT pair_id, d, i - row_number() OVER (PARTITION BY pair_id, d ORDER BY i) AS g FROM h), r AS (SELECT pair_id, max(n) AS n FROM (SELECT pair_id, d, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY ALL) SELECT p.pair_id, coalesce(n, 0) AS words FROM p LEFT JOIN r USING (pair_id)""")
def t32(t: Tables):
    d = t("documents")
    pairs = d.selectExpr("doc_id pair_id", "text a").join(d.selectExpr("doc_id - 1 pair_id", "text b"), "pair_id")
    return X.verbatim_overlap(pairs)


@query("t34_audit_counts", f"WITH {_LINES}, c AS (SELECT doc_id, count(*) AS counted FROM lines WHERE doc_id % 9 <> 0 GROUP BY ALL) SELECT doc_id AS query_id, CASE WHEN counted IS NULL THEN 'no_document' WHEN doc_id % 5 = 0 THEN 'no_number' WHEN doc_id % 4 = 0 THEN 'wrong' ELSE 'right' END AS verdict FROM documents LEFT JOIN c USING (doc_id)")
def t34(t: Tables):
    counts = X.lines(t("documents").where("doc_id % 9 <> 0")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("counted"))
    q = t("documents").selectExpr("doc_id query_id", "doc_id", "if(doc_id % 5 = 0, null, size(split(text, '\n')) + if(doc_id % 4 = 0, 1, 0)) claimed")
    return X.audit_counts(q, counts)


@query("t35_resolve_aliases", """WITH k AS (SELECT p_partkey, list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM part), y AS (SELECT DISTINCT p_partkey, unnest([array_to_string(w, ''), array_to_string(list_transform(w, lambda x: x[1]), '')]) AS key FROM k), n AS (SELECT key, count(DISTINCT p_partkey) AS n, min(p_partkey) AS label_id FROM y GROUP BY key)
 SELECT p_partkey AS mention_id, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN n = 1 THEN label_id END AS label_id FROM (SELECT p_partkey, regexp_replace(lower(CASE WHEN p_partkey % 7 = 0 THEN p_name || 'x' ELSE p_name END), '[^a-z0-9]+', '', 'g') AS key FROM part) LEFT JOIN n USING (key)""")
def t35(t: Tables):
    return X.resolve_aliases(t("part").selectExpr("p_partkey mention_id", "if(p_partkey % 7 = 0, concat(p_name, 'x'), p_name) mention"), t("part").selectExpr("p_partkey label_id", "p_name label"))
