"""Licence scan: TF-IDF cosine of licence headers and licence files to templates, and inheritance by directory.

A document with a licence cue anywhere is looked at in four ways: its title (the first line with words, alone and with
the next, if it reads like the heading of a licence), each of its lines with a cue, the block of comment lines at its
head, and its whole text. Distinct ones are scored once. They and the templates (short notices, tags, grants, whole
licence texts, and titles, which meet titles alone) are bags of words weighted by ln((1 + N) / (1 + df)) + 1 over all
of them in the corpus and the templates. A part names the template of the largest cosine, on four conditions: the
cosine reaches the threshold of its kind; the part states the version that the template's name has; the best template
of another name is ``MARGIN`` behind; and "Proprietary" is no word about a text that speaks of permission or a
licence. A title outweighs all other parts, since full terms quote other licences; under a heading that no template
has, only lines that grant something or the whole text count. Else a document takes the best of its parts.

It is a licence file if its title or whole text is such a match, or
if its file name says so and any part matches, and its directory hands the licence down: a document without one
of its own takes it from the nearest ancestor directory that has a licence file, found by joining directories
with directories.

Built from DataFrame functions alone. Templates are a table of fixed size and are broadcast; ancestors are
exploded per distinct directory, never per pair of files. What a directory inherits is joined by a shuffle, but for
directories that hold over one in ``HOT`` of all rows: these are fewer than ``HOT``, and their table is broadcast.

Edge cases: a null or empty text has no parts, a null path no directory; both give a null licence. Of two
licence files in one directory the better match, then the smaller name, counts; parts that
tie go to the smaller name. Rows that repeat id and path share the best of their parts. An empty table gives no rows.
Only id, path and text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headloom.llm.common import read_table, staged
from headloom.llm.licence_texts import TEMPLATES, TITLES

THRESHOLD = 0.7
WHOLE_THRESHOLD = 0.8
TITLE_THRESHOLD = 0.75
MARGIN = 0.02
HOT = 1024
TITLE_WORDS = 14
HEADING = r"(?i)\b(licen[sc]e|legal code)\b"
NO_HEADING = r"(?i)\b(under|by|see|this|with|from|is|are|identifier|you|may|file|copyright)\b"
GRANT = r"(?i)\b((licen[sc]ed|released|distributed|published|available) under|spdx-license-identifier)\b"
PERMITS = r"(?i)(licen[sc]e|permi(t|ssion)|redistribut|public domain|free software)"
CUE = r"(?i)\b(licen[sc]e[ds]?|unlicense|copyright|spdx|released under|all rights reserved|permission is|redistribution and use|free software|without (any )?(express )?warrant|public domain)"
COMMENT = r"^\s*(#|//|/\*|\*|--|;|%|<!--)"
FILE_NAME = r"(?i)(^|/)(un)?(licen[sc]e|copying|copyright|notice)[^/]*$"
_WORD = "[a-z0-9.]*[a-z0-9]"


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def versions(name: str, text: str) -> list[str] | None:
    """The words by which a part can state the version in a licence's name; null where name or template have none."""
    found = re.search(r"-(\d+\.\d+)$", name)
    plain = [found[1]] + [found[1][:-2]] * found[1].endswith(".0") if found else []
    known = [*plain, *("v" + x for x in plain)]
    return known if set(known) & set(re.findall(_WORD, text.lower())) else None


def parts(text: Column) -> Column:
    """Kind and text of what may hold a licence: titles, cue lines, a comment block of several lines at the head, the whole."""
    lines = F.split(text, "\n")
    top = F.slice(F.filter(lines, lambda x: x.rlike("[A-Za-z0-9]")), 1, 2)
    first_line = F.coalesce(F.get(top, F.lit(0)), F.lit(""))
    headed = first_line.rlike(HEADING) & ~first_line.rlike(NO_HEADING) & (F.size(words(first_line)) <= TITLE_WORDS)
    first = F.array_position(F.transform(lines, lambda x: ~x.rlike(COMMENT)), True) - 1
    count = F.when(first < 0, F.size(lines)).otherwise(first).cast("int")
    head = F.when(count > 1, F.array_join(F.slice(lines, 1, count), "\n"))
    made = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("part"))
    cued = F.transform(F.filter(lines, lambda x: x.rlike(CUE) & (~headed | x.rlike(GRANT))), lambda x: made("line", x))
    none = F.array().cast("array<struct<kind:string,part:string>>")
    titles = F.when(headed, F.array(made("title", first_line), made("title", F.array_join(top, " ")))).otherwise(none)
    heads = F.when(head.rlike(CUE), F.array(made("head", head))).otherwise(none)
    return F.when(text.rlike(CUE), F.concat(titles, cued, heads, F.array(made("whole", text))))


def _versions(name: str, text: str) -> Column:
    known = versions(name, text)
    return (F.array(*map(F.lit, known)) if known else F.lit(None)).cast("array<string>")


def _templates(spark: SparkSession, templates: list[tuple[str, str]], titles: list[tuple[str, str]]) -> DataFrame:
    given = [(False, *x) for x in templates] + [(True, *x) for x in titles]
    rows = F.array(*[
        F.struct(F.lit(i).alias("t"), F.lit(title).alias("title"), F.lit(name).alias("name"), _versions(name, text).alias("versions"), F.lit(text).alias("part"))
        for i, (title, name, text) in enumerate(given)
    ])
    return spark.range(1).select(F.explode(rows).alias("x")).select("x.*")


def scan(df: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates=TEMPLATES, titles=TITLES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, license, score, via (header, file, inherited) and from_dir, one row per row of ``df``."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.coalesce(text_col, F.lit("")).alias("text"))
    found = staged(docs.select("doc_id", "path", F.col("text").rlike(PERMITS).alias("permits"), parts(F.col("text")).alias("parts")), "licence-parts")
    each = found.select("doc_id", "path", "permits", F.explode("parts").alias("x")).select("doc_id", "path", "permits", "x.kind", "x.part")
    each = each.withColumn("title", F.col("kind") == "title").withColumn("key", F.sha2(F.concat(F.when(F.col("title"), "t").otherwise("p"), "part"), 256))
    own_parts = staged(each.select("doc_id", "path", "permits", "kind", "key"), "licence-keys")
    uses = own_parts.groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    bags = each.select("key", "title", "part").dropDuplicates(["key"]).select("key", "title", F.explode(words("part")).alias("word")).groupBy("key", "title", "word").agg(F.count(F.lit(1)).alias("tf"))
    bags = staged(bags.join(uses, "key"), "licence-bags")
    given = _templates(spark, templates, titles)
    model = given.select("t", "title", "name", "versions", F.explode(words("part")).alias("word")).groupBy("t", "title", "name", "versions", "word").agg(F.count(F.lit(1)).alias("tf"))
    seen = bags.select("word", "uses").unionByName(model.select("word", F.lit(1).cast("long").alias("uses"))).groupBy("word").agg(F.sum("uses").alias("df"))
    total = own_parts.count() + len(templates) + len(titles)
    idf = staged(seen.select("word", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf")), "licence-idf")

    def weighted(bag: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
        w = bag.join(idf, "word").select(*key, "word", (F.col("tf") * F.col("idf")).alias("w"))
        return w, w.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))

    part_w, part_norm = weighted(bags, "key", "title")
    model_w, model_norm = weighted(model, "t", "title", "name", "versions")
    model_w = model_w.join(model_norm.select("t", "norm"), "t").select("t", "title", "name", "versions", "word", (F.col("w") / F.col("norm")).alias("m"))
    cosine = part_w.join(F.broadcast(model_w), ["word", "title"]).groupBy("key", "t", "name", "versions").agg(F.sum(F.col("w") * F.col("m")).alias("dot"))
    stated = sorted({x for given_one in [*templates, *titles] for x in versions(*given_one) or []})
    numbers = bags.filter(F.col("word").isin(stated)).groupBy("key").agg(F.collect_set("word").alias("numbers"))
    cosine = cosine.join(part_norm.select("key", "norm"), "key").join(numbers, "key", "left")
    cosine = cosine.filter(F.col("versions").isNull() | F.arrays_overlap("versions", "numbers"))
    named = cosine.groupBy("key", "name").agg(F.max(F.round(F.col("dot") / F.col("norm"), 6)).alias("score"))
    ranked = named.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "name"))).alias("hits"))  # a name once at most
    lead = F.round(F.get("hits", F.lit(1))["s"] - F.get("hits", F.lit(0))["s"], 6)
    best = ranked.filter(F.coalesce(lead, F.lit(1.0)) >= MARGIN).select("key", F.get("hits", F.lit(0)).alias("hit"))
    best = staged(best, "licence-best")

    least = F.when(F.col("kind") == "title", TITLE_THRESHOLD).when(F.col("kind") == "whole", WHOLE_THRESHOLD).otherwise(threshold)
    hits = own_parts.join(best, "key").filter((-F.col("hit.s") >= least) & ~((F.col("hit.name") == "Proprietary") & F.col("permits")))
    order = F.struct((F.col("kind") != "title").alias("rest"), F.col("hit.s").alias("s"), F.col("hit.name").alias("name"))
    own = hits.groupBy("doc_id", "path").agg(F.min(order).alias("hit"), F.max(F.col("kind").isin("title", "whole")).alias("whole"))
    own = own.select(F.col("doc_id").alias("_d"), F.col("path").alias("_p"), F.col("hit.name").alias("own"), (-F.col("hit.s")).alias("own_score"), "whole")
    same = found["doc_id"].eqNullSafe(own["_d"]) & found["path"].eqNullSafe(own["_p"])
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    file = F.col("whole") | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    rows = staged(found.join(own, same, "left").select("doc_id", "path", "own", "own_score", file.alias("file"), folder.alias("dir")), "licence-own")

    files = rows.filter("own is not null and file").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own").alias("name"))).alias("hit"))
    files = staged(files.select(F.col("dir").alias("at"), "hit"), "licence-dirs")
    steps_of = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps_of)), lambda n: F.array_join(F.slice(steps_of, 1, n), "/"))
    steps = rows.filter("own is null and dir is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("at"))
    near = steps.join(files, "at").groupBy("dir").agg(F.max_by(F.struct("at", "hit"), F.length("at")).alias("up"))
    near = near.select("dir", F.col("up.at").alias("up_dir"), F.col("up.hit.name").alias("up_name"), (-F.col("up.hit.s")).alias("up_score"))
    near = staged(near, "licence-near")
    hot = rows.groupBy("dir").agg(F.count(F.lit(1)).alias("n")).filter(F.col("dir").isNotNull() & (F.col("n") * HOT > rows.count())).select("dir")
    hot = F.broadcast(staged(hot, "licence-hot"))
    cool = rows.filter("dir is not null").join(hot, "dir", "left_anti").join(near, "dir", "left")
    warm = rows.join(hot, "dir", "left_semi").join(F.broadcast(near.join(hot, "dir", "left_semi")), "dir", "left")
    out = cool.unionByName(warm).unionByName(rows.filter("dir is null"), allowMissingColumns=True)
    mine = F.col("own").isNotNull()
    return out.select(
        "doc_id", "path",
        F.coalesce("own", "up_name").alias("license"),
        F.when(mine, F.col("own_score")).otherwise(F.col("up_score")).alias("score"),
        F.when(mine & F.col("file"), "file").when(mine, "header").when(F.col("up_name").isNotNull(), "inherited").alias("via"),
        F.when(mine, F.lit(None)).otherwise(F.col("up_dir")).alias("from_dir"),
    )


def document_path() -> Column:
    """The documents have no paths: source and language serve as directories."""
    return F.concat_ws("/", F.col("source"), F.col("lang"), F.col("doc_id").cast("string"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("path", document_path())
    return scan(docs.select("doc_id", "path", "text"))


def _row(title: bool, name: str, text: str) -> str:
    return "({}, '{}', {}, '{}')".format(title, name, versions(name, text) or "NULL", text.replace("'", "''"))


_VALUES = ", ".join([_row(False, *x) for x in TEMPLATES] + [_row(True, *x) for x in TITLES])
_STATED = ", ".join(f"'{x}'" for x in sorted({x for given in [*TEMPLATES, *TITLES] for x in versions(*given) or []}))
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_matches(text, '{PERMITS}') AS permits, string_split(text, chr(10)) AS ls FROM d WHERE regexp_matches(text, '{CUE}')),
v AS (SELECT *, list_filter(ls, lambda x: regexp_matches(x, '[A-Za-z0-9]'))[1:2] AS top FROM w),
q AS (SELECT *, regexp_matches(top[1], '{HEADING}') AND NOT regexp_matches(top[1], '{NO_HEADING}')
        AND len(regexp_extract_all(lower(top[1]), '{_WORD}')) <= {TITLE_WORDS} AS headed FROM v),
h AS (SELECT *, CASE WHEN list_position(list_transform(ls, lambda x: NOT regexp_matches(x, '{COMMENT}')), true) > 0
        THEN list_position(list_transform(ls, lambda x: NOT regexp_matches(x, '{COMMENT}')), true) - 1 ELSE len(ls) END AS n FROM q),
l0 AS (SELECT doc_id, path, permits, 'line' AS kind, unnest(list_filter(ls, lambda x: regexp_matches(x, '{CUE}') AND (NOT headed OR regexp_matches(x, '{GRANT}')))) AS part FROM h
      UNION ALL SELECT doc_id, path, permits, 'title', unnest([top[1], array_to_string(top, ' ')]) FROM h WHERE headed
      UNION ALL SELECT doc_id, path, permits, 'head', array_to_string(ls[1:n], chr(10)) FROM h WHERE n > 1 AND regexp_matches(array_to_string(ls[1:n], chr(10)), '{CUE}')
      UNION ALL SELECT doc_id, path, permits, 'whole', text FROM h),
l AS (SELECT *, (kind = 'title') AS title FROM l0),
u AS (SELECT title, part, count(*) AS uses FROM l GROUP BY ALL),
t AS (SELECT row_number() OVER () AS t, * FROM (VALUES {_VALUES}) v(title, name, vers, part)),
bw AS (SELECT title, part, uses, word, count(*) AS tf FROM (SELECT title, part, uses, unnest(regexp_extract_all(lower(part), '{_WORD}')) AS word FROM u) GROUP BY ALL),
mw AS (SELECT t, word, count(*) AS tf FROM (SELECT t, unnest(regexp_extract_all(lower(part), '{_WORD}')) AS word FROM t) GROUP BY ALL),
n AS (SELECT (SELECT coalesce(sum(uses), 0) FROM u) + (SELECT count(*) FROM t) AS total),
idf AS (SELECT word, ln((1.0 + (SELECT total FROM n)) / (1 + sum(uses))) + 1 AS idf
        FROM (SELECT word, uses FROM bw UNION ALL SELECT word, 1 FROM mw) GROUP BY word),
lw AS (SELECT title, part, word, tf * idf AS w FROM bw JOIN idf USING (word)),
ln AS (SELECT title, part, sqrt(sum(w * w)) AS norm FROM lw GROUP BY ALL),
tw AS (SELECT t, word, tf * idf AS w FROM mw JOIN idf USING (word)),
tn AS (SELECT t, sqrt(sum(w * w)) AS norm FROM tw GROUP BY t),
no AS (SELECT title, part, list(DISTINCT word) AS numbers FROM bw WHERE word IN ({_STATED}) GROUP BY ALL),
c AS (SELECT lw.title, lw.part, t.name, t.vers, round(sum(lw.w * tw.w / tn.norm) / any_value(ln.norm), 6) AS score
      FROM lw JOIN tw USING (word) JOIN t ON t.t = tw.t AND t.title = lw.title JOIN tn ON tn.t = tw.t
      JOIN ln ON ln.part = lw.part AND ln.title = lw.title GROUP BY lw.title, lw.part, t.t, t.name, t.vers),
m AS (SELECT c.title, c.part, name, max(score) AS score FROM c LEFT JOIN no ON no.part = c.part AND no.title = c.title
      WHERE vers IS NULL OR list_has_any(coalesce(numbers, []), vers) GROUP BY ALL),
b AS (SELECT title, part, name, score, round(score - lead(score) OVER best, 6) AS ahead FROM m
      WINDOW best AS (PARTITION BY title, part ORDER BY score DESC, name) QUALIFY row_number() OVER best = 1),
o AS (SELECT l.doc_id, l.path, b.name, b.score, bool_or(kind IN ('title', 'whole')) OVER (PARTITION BY l.doc_id, l.path) AS whole
      FROM l JOIN b USING (title, part)
      WHERE coalesce(ahead, 1) >= {MARGIN} AND NOT (b.name = 'Proprietary' AND permits)
        AND score >= CASE kind WHEN 'title' THEN {TITLE_THRESHOLD} WHEN 'whole' THEN {WHOLE_THRESHOLD} ELSE {THRESHOLD} END
      QUALIFY row_number() OVER (PARTITION BY l.doc_id, l.path ORDER BY title DESC, b.score DESC, b.name) = 1),
r AS (SELECT d.doc_id, d.path, o.name, o.score, o.whole OR regexp_matches(d.path, '{FILE_NAME}') AS file,
        CASE WHEN contains(d.path, '/') THEN regexp_replace(d.path, '/[^/]*$', '') WHEN d.path IS NOT NULL THEN '' END AS dir
      FROM d LEFT JOIN o ON o.doc_id = d.doc_id AND o.path = d.path),
f AS (SELECT dir, name, score FROM r WHERE file AND name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, name) = 1),
a AS (SELECT DISTINCT dir, dir AS up FROM r UNION SELECT dir, CASE WHEN contains(up, '/') THEN regexp_replace(up, '/[^/]*$', '') ELSE '' END FROM a WHERE up <> ''),
x AS (SELECT a.dir, a.up, f.name, f.score FROM a JOIN f ON f.dir = a.up QUALIFY row_number() OVER (PARTITION BY a.dir ORDER BY length(a.up) DESC) = 1)
SELECT r.doc_id, r.path, coalesce(r.name, x.name) AS license, CASE WHEN r.name IS NOT NULL THEN r.score ELSE x.score END AS score,
  CASE WHEN r.name IS NOT NULL AND r.file THEN 'file' WHEN r.name IS NOT NULL THEN 'header' WHEN x.name IS NOT NULL THEN 'inherited' END AS via,
  CASE WHEN r.name IS NULL THEN x.up END AS from_dir
FROM r LEFT JOIN x ON x.dir = r.dir
"""
