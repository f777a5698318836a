"""Queries of outlines, page windows and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import normalize, quantised
from quire.operators import outline, vector, windows
from quire.plans._q import BOOKS, PAGES, norm, paged, pieces, q6
from quire.plans.answer_queries import rec, recorded
from quire.sources import shelf


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks nation > market > supplier of each region's book: a supplier's page is its place by key."""
    t = lambda n: shelf.table(spark, sf_dir, n)
    rows = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    group = F.concat(F.lit("group "), (F.col("s_suppkey") % 3).cast("string"))
    rows = rows.select(F.col("r_name").alias("book"), "n_name", group.alias("grp"), "s_name")
    named = rows.select("book", F.col("n_name").alias("path"), F.lit(1).alias("depth")).distinct()
    named = named.unionAll(rows.select("book", F.concat_ws(outline.SEPARATOR, "n_name", "grp"), F.lit(2)).distinct()).unionAll(rows.select("book", F.concat_ws(outline.SEPARATOR, "n_name", "grp", "s_name"), F.lit(3)))
    order = Window.partitionBy("book").orderBy("path")
    # leaves are pages in order; a group starts at its first leaf
    leaf = F.sum(F.when(F.col("depth") == 3, 1).otherwise(0)).over(order)
    start = F.when(F.col("depth") == 3, leaf).otherwise(leaf + 1)
    out = named.withColumns({"pos": F.row_number().over(order), "start": start.cast("int")})
    # every 7th leaf's destination does not resolve
    return out.withColumn("start", F.when((F.col("depth") == 3) & (F.col("start") % 7 == 0), None).otherwise(F.col("start")))


_PATHS = """rw AS (SELECT r_name AS book, n_name, 'group ' || CAST(s_suppkey % 3 AS VARCHAR) AS grp, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
nm AS (SELECT DISTINCT book, n_name AS path, 1 AS depth FROM rw UNION ALL SELECT DISTINCT book, n_name || ' > ' || grp, 2 FROM rw UNION ALL SELECT book, n_name || ' > ' || grp || ' > ' || s_name, 3 FROM rw),
o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY path) AS pos, sum(CASE WHEN depth = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY path) AS leaf FROM nm),
en AS (SELECT book, path, depth, CAST(pos AS INTEGER) AS pos, CAST(CASE WHEN depth = 3 THEN CASE WHEN leaf % 7 = 0 THEN NULL ELSE leaf END ELSE leaf + 1 END AS INTEGER) AS start FROM o)"""


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _paths(spark, sf_dir)
    pages = entries.where("depth = 3").groupBy("book").agg(F.count("*").cast("int").alias("pages"))
    return outline.ranges(entries, pages, 3)


_RANGES = f"""{_PATHS}, ct AS (SELECT book, count(*) AS pages FROM en WHERE depth = 3 GROUP BY book),
nx AS (SELECT a.book, a.pos, min(b.pos) AS nextpos FROM en a LEFT JOIN en b ON a.book = b.book AND b.pos > a.pos AND b.depth <= a.depth GROUP BY a.book, a.pos),
rg AS (SELECT en.book, en.pos, en.path, en.depth, en.start, CAST(greatest(en.start, coalesce((SELECT max(c.start) FROM en c WHERE c.book = en.book AND c.pos > en.pos AND (nextpos IS NULL OR c.pos < nextpos)), en.start),
  CASE WHEN f.start IS NOT NULL THEN f.start - 1 ELSE pages END) AS INTEGER) AS "end"
  FROM en JOIN nx ON en.book = nx.book AND en.pos = nx.pos LEFT JOIN en f ON f.book = en.book AND f.pos = nextpos JOIN ct ON ct.book = en.book WHERE en.start IS NOT NULL)"""


def outline_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir).select("book", "path", "start", "end")


def children_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.children(_paths(spark, sf_dir))


def membership_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that a supplier is listed under a nation, half of them wrong: a positive is final, a negative only confines."""
    t = lambda n: shelf.table(spark, sf_dir, n)
    claims = t("supplier").select(F.upper("s_name").alias("member"), (F.col("s_nationkey") + F.col("s_suppkey") % 2).alias("key")).join(t("nation"), F.col("key") % 25 == F.col("n_nationkey")).select("member", F.col("n_name").alias("parent"))
    leaves = _paths(spark, sf_dir).where("depth = 3").select(normalize(F.element_at(F.split("path", outline.SEPARATOR), -1)).alias("name"), F.element_at(F.split("path", outline.SEPARATOR), 1).alias("under")).distinct()
    listed = leaves.select("name", F.col("under").alias("parent"), F.lit(True).alias("listed"))
    met = claims.withColumn("name", normalize(F.col("member"))).join(listed, ["name", "parent"], "left")
    return met.select("member", "parent", F.when(F.col("listed"), "true").otherwise("confine").alias("verdict"))


def coarse_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir).where("depth <= 2").select("book", "path", "start", "end", "depth")


def sections_under_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Below the two widest nations of each book, the two longest ranges each (coarse to fine)."""
    every = _ranges(spark, sf_dir)
    width = F.col("end") - F.col("start")
    best = every.where("depth = 1").withColumn("k", F.row_number().over(Window.partitionBy("book").orderBy(width.desc(), "path"))).where("k <= 2")
    return outline.under(every, best).select("book", "path", "start", "end")


def _sections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = paged(spark, sf_dir)
    return pages, shelf.sections(pages)


_SECTIONS = f"""{PAGES}, {BOOKS}, kk AS (SELECT book, pages, unnest(range(0, CAST(ceil(pages / 5.0) AS BIGINT))) AS k FROM bk),
sc AS (SELECT book, book AS path, 1 AS start, pages AS "end", 1 AS depth FROM bk
  UNION ALL SELECT book, book || ' > chapter ' || CAST(k + 1 AS VARCHAR), k * 10 + 1, least((k + 1) * 10, pages), 2 FROM kk WHERE k < ceil(pages / 10.0)
  UNION ALL SELECT book, book || ' > chapter ' || CAST(k // 2 + 1 AS VARCHAR) || ' > part ' || CAST(k + 1 AS VARCHAR), k * 5 + 1, least((k + 1) * 5, pages), 3 FROM kk)"""


def sections_holding_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections below the top that hold one of each book's three longest pages."""
    pages, sections = _sections(spark, sf_dir)
    long = pages.withColumn("k", F.row_number().over(Window.partitionBy("book").orderBy(F.desc(F.length("text")), "page"))).where("k <= 3")
    return outline.holding(sections.where("depth > 1"), long.select("book", "page")).select("book", "path", "start", "end")


def narrowest_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, sections = _sections(spark, sf_dir)
    return outline.narrowest(pages.select("book", "page"), sections)


def confine_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools of every group of bookmarks."""
    every = _ranges(spark, sf_dir)
    return outline.confine(every, every.where("depth = 2").select("book", F.col("path").alias("parent")))


def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, sections = _sections(spark, sf_dir)
    items = windows.section_pages(pages, sections.where("depth = 2"))
    out = items.select("book", "path", F.explode(windows.page_windows(F.col("items"), 6000)).alias("w"))
    return out.select("book", "path", "w.page", "w.end", "w.chars")


def page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, sections = _sections(spark, sf_dir)
    items = windows.section_pages(pages, sections.where("depth = 2"))
    numbered = items.select("book", "path", "items", windows.batches(F.transform("items", lambda i: i["chars"]), 8000).alias("ids"))
    rows = numbered.select("book", "path", F.explode(F.arrays_zip("items", "ids")).alias("z"))
    return rows.groupBy("book", "path", F.col("z.ids").alias("batch")).agg(F.min("z.items.page").alias("page"), F.count("*").alias("pages"), F.sum("z.items.chars").alias("chars"))


def page_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut into pieces of at most 700 characters at sentence ends, blank lines, or spaces."""
    rows = paged(spark, sf_dir).select("book", "page", F.posexplode(windows.pieces(F.col("text"), 700)).alias("piece", "text"))
    return rows.select("book", "page", "piece", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def piece_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of at most 4,000 characters over a page's pieces."""
    cut = paged(spark, sf_dir).select("book", "page", F.transform(windows.pieces(F.col("text"), 700), F.length).alias("sizes"))
    rows = cut.select("book", "page", F.explode(F.arrays_zip("sizes", windows.batches(F.col("sizes"), 4000).alias("call"))).alias("z"))
    return rows.groupBy("book", "page", "z.call").agg(F.count("*").alias("pieces"), F.sum("z.sizes").alias("chars"))


def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best run of lines of each document, a line's share being that of its letters among its characters, in hundredths."""
    lines = shelf.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    letters = F.length(F.regexp_replace("line", "[^a-z]", ""))
    share = F.when(F.length("line") > 0, F.floor(letters * 100 / F.length("line"))).otherwise(0).cast("long")
    return windows.best_run(lines.withColumn("share", share), "doc_id", "at", "share", 80)


def _best_pages(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    chunks = shelf.table(spark, sf_dir, "embeddings").select(F.col("label").alias("book"), F.floor(F.col("vec_id") / 2).cast("long").alias("page"), F.col("embedding").alias("v"))
    queries = shelf.table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    return vector.top_pages(vector.page_similarity(chunks, queries, most), most).select("qid", "book", "page", "similarity", "rank")


def page_similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks are embeddings in tens, a page each, a label a book; every vector whose id is divisible by 100 asks."""
    return _best_pages(spark, sf_dir, 20)


def shortlist_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 16 pages that hold a question's five most similar pages."""
    top = _best_pages(spark, sf_dir, 5)
    return top.select("qid", "book", F.floor(F.col("page") / 16).alias("section")).distinct()


def cache_lookup_or_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is a question asked before; those whose id is divisible by 100 look for another one of their book to reuse."""
    e = shelf.table(spark, sf_dir, "embeddings").select(F.col("label").alias("book"), F.col("vec_id").alias("id"), F.col("embedding").alias("rich"), F.slice("embedding", 1, 16).alias("subj"))
    out = vector.cache_lookup(e.where("id % 100 = 0"), e, 0.3, 0.5)
    return out.select("book", "id", "cached", "whole", quantised(F.col("part")).alias("part"))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of five books of brands: brand > type, and under some types the names of their parts."""
    part = shelf.table(spark, sf_dir, "part").select(F.concat(F.lit("book "), (F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int") % 5).cast("string")).alias("book"), F.regexp_replace("p_brand", "#", " ").alias("brand"), "p_type", "p_name")
    listed = recorded("lists", F.col("brand"), F.col("p_type")) >= 75
    kind, join = F.concat_ws(outline.SEPARATOR, "brand", "p_type"), lambda *c: F.concat_ws(outline.SEPARATOR, *c)
    rows = part.select("book", F.col("brand").alias("path")).unionAll(part.select("book", kind)).unionAll(part.where(listed).select("book", join("brand", "p_type", "p_name")))
    return rows.distinct()


def outline_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions of every group of the contents, as if it were picked, and one of every book, by recorded answers."""
    paths = _catalogue(spark, sf_dir)
    every = outline.groups(paths).where("kids > 1").select("book", "parent", recorded("pick", F.col("book"), F.col("parent")).alias("own"))
    asked = every.withColumn("counted", F.explode(F.array(F.lit(""), F.lit("named brands"), F.lit("bolts"))))
    picks = asked.select(F.concat_ws("/", "book", "parent", "counted").alias("qid"), "book", "parent", F.greatest("own", F.lit(55)).alias("p"), recorded("grouped", F.col("parent")).alias("g"), "counted")
    first = every.groupBy("book").agg(F.max(F.struct("own", "parent")).alias("b")).select(F.col("book").alias("qid"), "book", "b.parent", F.col("b.own").alias("p"), F.lit(0).alias("g"), F.lit("").alias("counted"))
    picks = picks.unionByName(first).withColumn("grouped", F.when(F.col("g") >= 80, 60).otherwise(10)).drop("g")
    return outline.counted(paths, picks, 60)


QUERIES = {f.__name__: f for f in (outline_count, outline_ranges, children_by_parent, membership_claim, coarse_sections, sections_under_best, sections_holding_pages, narrowest_section, confine_sections, page_windows, page_batches, page_pieces, piece_batches, best_run, page_similarity_topk, shortlist_sections, cache_lookup_or_rule)}
_SIM = f"""q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
sim AS (SELECT qid, label AS book, vec_id // 2 AS page, {q6('max(list_cosine_similarity(embedding::DOUBLE[], qv))')} AS similarity FROM embeddings, q GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid, book ORDER BY similarity DESC, page) AS rank FROM sim)"""
_FOLD = f"""WITH RECURSIVE {_SECTIONS},
it AS (SELECT sc.book, sc.path, pg.page, length(pg.text) AS chars, row_number() OVER (PARTITION BY sc.path ORDER BY page) AS i, count(*) OVER (PARTITION BY sc.path) AS n FROM sc JOIN pg ON pg.book = sc.book AND page BETWEEN start AND "end" WHERE depth = 2)"""
_PIECES = pieces(700)
ORACLE = {
    "outline_count": f"""WITH p0 AS (SELECT 'book ' || CAST(CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 5 AS VARCHAR) AS book, replace(p_brand, '#', ' ') AS brand, p_type, p_name FROM part),
en AS (SELECT book, brand AS path FROM p0 UNION SELECT book, brand || ' > ' || p_type FROM p0 UNION SELECT book, brand || ' > ' || p_type || ' > ' || p_name FROM p0 WHERE {rec("'lists'", 'brand', 'p_type')} >= 75),
kid AS (SELECT book, path, regexp_extract(path, '^(.*) > ', 1) AS parent FROM en WHERE contains(path, ' > ')),
g AS (SELECT book, parent, count(*) AS kids FROM kid GROUP BY ALL HAVING count(*) > 1),
o AS (SELECT *, {rec("'pick'", 'book', 'parent')} AS own FROM g),
pk AS (SELECT book || '/' || parent || '/' || counted AS qid, book, parent, kids, greatest(own, 55) AS p, {rec("'grouped'", 'parent')} >= 80 AS grouped, counted FROM o, (SELECT unnest(['', 'named brands', 'bolts']) AS counted)
  UNION ALL SELECT book, book, parent, kids, own, false, '' FROM o QUALIFY row_number() OVER (PARTITION BY book ORDER BY own DESC, parent DESC) = 1),
j AS (SELECT *, CASE WHEN contains(parent, ' > ') THEN regexp_extract(parent, '^(.*) > ', 1) END AS above,
  EXISTS (SELECT 1 FROM kid k WHERE k.book = pk.book AND k.parent = pk.parent AND (SELECT count(*) FROM kid i WHERE i.book = k.book AND i.parent = k.path) > pk.kids) AS lost FROM pk WHERE p >= 60),
s AS (SELECT *, (SELECT count(*) FROM kid k WHERE k.book = j.book AND k.parent = j.above AND k.path <> j.parent) AS siblings,
  NOT EXISTS (SELECT 1 FROM kid k JOIN kid i ON i.book = k.book AND i.parent = k.path WHERE k.book = j.book AND k.parent = j.above AND k.path <> j.parent) AS leaves,
  counted = '' OR (counted = 'named brands' AND contains(lower(above), 'brand ')) OR (counted = 'bolts' AND contains(' ' || lower(above) || ' ', ' bolt ')) AS about FROM j),
v AS (SELECT *, NOT grouped AND NOT lost AND siblings > 0 AND siblings < kids AND leaves AND about AS swallowed FROM s)
SELECT qid, book, CASE WHEN swallowed THEN above ELSE parent END AS parent, CASE WHEN NOT (grouped OR lost OR swallowed) THEN CAST(kids AS VARCHAR) END AS text, CASE WHEN NOT (grouped OR lost OR swallowed) THEN p END AS p FROM v""",
    "outline_ranges": f'WITH {_RANGES} SELECT book, path, start, "end" FROM rg',
    "children_by_parent": f"WITH {_PATHS}, p AS (SELECT book, regexp_extract(path, '^(.*) > ', 1) AS parent, string_split(path, ' > ')[-1] AS name FROM en WHERE contains(path, ' > ')) SELECT book, parent, count(*) AS children, string_agg(name, '; ' ORDER BY name) AS names FROM p GROUP BY book, parent",
    "membership_claim": f"WITH {_PATHS}, c AS (SELECT upper(s_name) AS member, n_name AS parent FROM supplier JOIN nation ON (s_nationkey + s_suppkey % 2) % 25 = n_nationkey), l AS (SELECT DISTINCT {norm('s_name')} AS name, n_name AS parent FROM rw) SELECT member, c.parent, CASE WHEN l.name IS NOT NULL THEN 'true' ELSE 'confine' END AS verdict FROM c LEFT JOIN l ON l.parent = c.parent AND l.name = {norm('member')}",
    "coarse_sections": f'WITH {_RANGES} SELECT book, path, start, "end", depth FROM rg WHERE depth <= 2',
    "sections_under_best": f"""WITH {_RANGES}, b AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY "end" - start DESC, path) AS k FROM rg WHERE depth = 1) SELECT book, path, start, "end" FROM rg WHERE EXISTS (SELECT 1 FROM b WHERE b.k <= 2 AND b.book = rg.book AND starts_with(rg.path, b.path || ' > '))""",
    "sections_holding_pages": f'WITH {_SECTIONS}, l AS (SELECT book, page, row_number() OVER (PARTITION BY book ORDER BY length(text) DESC, page) AS k FROM pg) SELECT book, path, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end" FROM sc WHERE depth > 1 AND EXISTS (SELECT 1 FROM l WHERE k <= 3 AND l.book = sc.book AND l.page BETWEEN start AND "end")',
    "narrowest_section": f'WITH {_SECTIONS}, r AS (SELECT pg.book, page, path, start, "end", row_number() OVER (PARTITION BY pg.book, page ORDER BY "end" - start, depth DESC, path) AS k FROM pg JOIN sc ON sc.book = pg.book AND page BETWEEN start AND "end") SELECT book, page, path, start, "end" FROM r WHERE k = 1',
    "confine_sections": f"""WITH {_RANGES}, p AS (SELECT book, path AS parent FROM rg WHERE depth = 2), a AS (SELECT *, regexp_extract(parent, '^(.*) > ', 1) AS above FROM p)
SELECT p.book, parent, path, start, "end" FROM p JOIN rg ON rg.book = p.book AND (path = parent OR starts_with(path, parent || ' > '))
UNION ALL SELECT a.book, a.parent, above || ' (opening)', c.start, f.first - 1 FROM a JOIN rg c ON c.book = a.book AND c.path = above JOIN LATERAL (SELECT min(start) AS first FROM rg x WHERE x.book = a.book AND starts_with(x.path, above || ' > ')) f ON true WHERE f.first > c.start""",
    "page_windows": f"""{_FOLD}, fold AS (
  SELECT book, path, i, n, page AS first, page AS last, chars, NULL::INTEGER AS cf, NULL::INTEGER AS cl, NULL::BIGINT AS cc FROM it WHERE i = 1
  UNION ALL
  SELECT f.book, f.path, t.i, f.n, CASE WHEN f.chars > 0 AND f.chars + t.chars > 6000 THEN t.page ELSE f.first END, t.page, CASE WHEN f.chars > 0 AND f.chars + t.chars > 6000 THEN t.chars ELSE f.chars + t.chars END,
    CASE WHEN f.chars > 0 AND f.chars + t.chars > 6000 THEN f.first END, CASE WHEN f.chars > 0 AND f.chars + t.chars > 6000 THEN f.last END, CASE WHEN f.chars > 0 AND f.chars + t.chars > 6000 THEN f.chars END
  FROM fold f JOIN it t ON t.path = f.path AND t.i = f.i + 1),
w AS (SELECT book, path, cf AS page, cl AS "end", cc AS chars FROM fold WHERE cf IS NOT NULL UNION ALL SELECT book, path, first, last, chars FROM fold WHERE i = n),
tx AS (SELECT w.*, string_agg(text, '' ORDER BY pg.page) AS text FROM w JOIN pg ON pg.book = w.book AND pg.page BETWEEN w.page AND w."end" GROUP BY ALL)
SELECT book, path, page, "end", CAST(chars AS INTEGER) AS chars FROM tx WHERE length(trim(text, '{windows.BLANKS}')) > 200""",
    "page_pieces": f"WITH RECURSIVE {_PIECES} SELECT book, page, CAST(piece - 1 AS INTEGER) AS piece, CAST(length(text) AS INTEGER) AS chars, md5(text) AS digest FROM pc",
    "piece_batches": f"""WITH RECURSIVE {_PIECES}, cl AS (SELECT book, page, piece, length(text) AS own, length(text) AS size, 1 AS call FROM pc WHERE piece = 1
  UNION ALL SELECT c.book, c.page, p.piece, length(p.text), CASE WHEN c.size + length(p.text) > 4000 THEN length(p.text) ELSE c.size + length(p.text) END, CASE WHEN c.size + length(p.text) > 4000 THEN c.call + 1 ELSE c.call END FROM cl c JOIN pc p ON p.book = c.book AND p.page = c.page AND p.piece = c.piece + 1)
SELECT book, page, call, count(*) AS pieces, CAST(sum(own) AS BIGINT) AS chars FROM cl GROUP BY ALL""",
    "page_batches": f"""{_FOLD}, fold AS (
  SELECT book, path, i, page, chars AS own, chars AS size, 1 AS batch FROM it WHERE i = 1
  UNION ALL SELECT f.book, f.path, t.i, t.page, t.chars, CASE WHEN f.size + t.chars > 8000 THEN t.chars ELSE f.size + t.chars END, CASE WHEN f.size + t.chars > 8000 THEN f.batch + 1 ELSE f.batch END FROM fold f JOIN it t ON t.path = f.path AND t.i = f.i + 1)
SELECT book, path, batch, min(page) AS page, count(*) AS pages, CAST(sum(own) AS BIGINT) AS chars FROM fold GROUP BY book, path, batch""",
    "best_run": """WITH l AS (SELECT doc_id, unnest(range(0, len(p))) AS i, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
s AS (SELECT doc_id, i, CASE WHEN length(line) > 0 THEN CAST(floor(length(regexp_replace(line, '[^a-z]', '', 'g')) * 100 / length(line)) AS BIGINT) ELSE 0 END - 80 AS x FROM l),
c AS (SELECT *, sum(x) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM s UNION ALL SELECT DISTINCT doc_id, -1, 0, 0 FROM s),
r AS (SELECT a.doc_id, b.i AS start, a.i AS fin, a.s - b.s AS gain FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i < a.i WHERE a.s > b.s),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gain DESC, fin, start DESC) AS k FROM r) SELECT doc_id, CAST(start + 1 AS INTEGER) AS start, CAST(fin + 1 AS INTEGER) AS "end", CAST(gain AS BIGINT) AS gain FROM k WHERE k = 1""",
    "page_similarity_topk": f"WITH {_SIM} SELECT qid, book, page, similarity, rank FROM rk WHERE rank <= 20",
    "shortlist_sections": f"WITH {_SIM} SELECT DISTINCT qid, book, page // 16 AS section FROM rk WHERE rank <= 5",
    "cache_lookup_or_rule": f"""WITH e AS (SELECT label AS book, vec_id AS id, embedding::DOUBLE[] AS rich, (embedding::DOUBLE[])[1:16] AS subj FROM embeddings),
n AS (SELECT a.book, a.id, b.id AS cached, list_cosine_similarity(a.rich, b.rich) AS whole, list_cosine_similarity(a.subj, b.subj) AS part FROM e a JOIN e b ON a.book = b.book AND a.id % 100 = 0 AND a.id <> b.id),
g AS (SELECT *, {q6('whole')} AS w, row_number() OVER (PARTITION BY book, id ORDER BY floor(whole * 1000000 + 0.5) DESC, cached) AS k FROM n WHERE whole >= 0.3 OR part >= 0.5) SELECT book, id, cached, w AS whole, {q6('part')} AS part FROM g WHERE k = 1""",
}
