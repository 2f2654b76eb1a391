"""Triples, entities and property graphs as tables of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.session import checkpointed

#: Relations between two names, in the order they are tried: (predicate, phrases, confidence). Fixed values.
RELATIONS = (
    ("authored_by", "was authored by|is authored by", 0.9),
    ("created_by", "was created by|is made by|is developed by|is built by", 0.9),
    ("located_in", "is located in|is based in|is headquartered in|is found in", 0.9),
    ("subset_of", "is a subset of|is a member of|is member of", 0.88),
    ("part_of", "is part of|belongs to|is a component of", 0.85),
    ("leverages", "leverages|employs", 0.82),
    ("uses", "uses|requires|depends on|needs|utilizes", 0.8),
    ("has", "has|contains|includes|provides", 0.75),
    ("is_a", "is (?:a|an|the)", 0.85),
    ("related_to", None, 0.7),
    ("associated_with", "is associated with|is connected to", 0.7),
    ("synonym_of", "also known as|aka|also called", 0.9),
    ("succeeds", "succeeds|replaces|supersedes", 0.85),
    ("member_of", "is a member of|is member of", 0.85),
    ("precedes", "precedes|is followed by|comes before", 0.8),
)
#: Predicates that mean the same when triples are deduplicated: fixed values.
GROUPS = {
    "identity": ("is_a", "is", "equals", "synonym_of"),
    "membership": ("part_of", "belongs_to", "member_of", "subset_of"),
    "creation": ("created_by", "authored_by", "made_by", "built_by"),
    "location": ("located_in", "found_in", "based_in"),
    "usage": ("uses", "uses_tool", "leverages", "employs"),
    "possession": ("has", "contains", "includes", "owns"),
    "relation": ("related_to", "associated_with", "connected_to"),
}
#: A run of words without anything but white space between them. A match of two names and a phrase lies in one run and
#: fills it from its first word, so runs are found first. Possessive: nothing is tried again, and no word takes stack.
_RUN = r"(?i)[A-Z][A-Z0-9]*+(?:\s++[A-Z][A-Z0-9]*+)*+"
_SAID = r"(?i)\b(?:" + "|".join(p for _, p, _ in RELATIONS if p) + r"|are)\b"


def _between(phrases: str) -> str:
    """A run around the last of some phrases that has words on both sides; tried once at each end of a word."""
    return rf"(?is)^(.*[a-z0-9])\s++(?:{phrases.replace('is (?:a|an|the)', r'is\s++(?:a|an|the)')})\s++(.+)$"


def runs_in(sentence: Column) -> Column:
    """The runs of words of a sentence in which a relation may be named."""
    return F.filter(F.regexp_extract_all(sentence, F.lit(_RUN), F.lit(0)), lambda r: r.rlike(_SAID))


def relations_in(runs: Column) -> Column:
    """An array of (subject, predicate, object, confidence, rank) of all relations that a sentence's runs
    name; rank is the relation's place in the order of trial, then the match's. The runs should be a column of
    their own."""
    def matches(i: int, predicate: str, phrases: str | None, confidence: float) -> Column:
        p = _between(phrases or "and")
        told = runs if phrases else F.transform(runs, lambda r: F.regexp_extract(r, r"(?is)^(.*[a-z0-9])\s++are\s++related", 1))
        return F.transform(
            F.filter(told, lambda r: r.rlike(p)),
            lambda r, j: F.struct(
                F.regexp_extract(r, p, 1).alias("subject"), F.lit(predicate).alias("predicate"), F.regexp_extract(r, p, 2).alias("object"),
                F.lit(confidence).alias("confidence"), (F.lit(i * 10_000) + j).alias("rank"),
            ),
        )

    found = [matches(i, *relation) for i, relation in enumerate(RELATIONS)]
    return F.filter(F.flatten(F.array(*found)), lambda t: F.lower(t["subject"]) != F.lower(t["object"]))


def triples(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, subject, predicate, object, confidence, sentence, pos): relations of each text's sentences, of
    equal ones (case ignored) the first; pos orders a text's triples."""
    rows = docs.select(id_col, F.posexplode(T.sentences(F.coalesce(F.col(text_col), F.lit("")))).alias("_s", "sentence"))
    near = rows.where(F.col("sentence").rlike(_SAID)).withColumn("_runs", runs_in(F.col("sentence"))).where(F.size("_runs") > 0)
    found = near.select(id_col, "_s", "sentence", F.explode(relations_in(F.col("_runs"))).alias("t")).select(id_col, "_s", "sentence", "t.*")
    by = Window.partitionBy(id_col, F.lower("subject"), "predicate", F.lower("object")).orderBy("_s", "rank")
    first = found.withColumn("_n", F.row_number().over(by)).where("_n = 1")
    return first.select(id_col, "subject", "predicate", "object", "confidence", "sentence", F.struct("_s", "rank").alias("pos"))


def group_of(predicate: Column) -> Column:
    out = predicate
    for name, members in GROUPS.items():
        out = F.when(predicate.isin(*members), F.lit(name)).otherwise(out)
    return out


def first_by_group(found: DataFrame, order: list[str]) -> DataFrame:
    """Of triples of equal subject and object (case ignored) and one group of predicates, the first."""
    by = Window.partitionBy(F.lower("subject"), group_of(F.col("predicate")), F.lower("object")).orderBy(*order)
    return found.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def markdown_triples(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, subject, predicate, object, confidence) of headings, two-column table rows, definitions
    and bullets; a definition under a heading belongs to its section as well."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, r"\r\n|\n|\r")).alias("line", "_raw")).withColumn("_l", F.trim("_raw"))
    heading = F.trim(F.regexp_extract("_l", r"^#{1,6}\s+(.+)$", 1))
    by = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_h", F.last(F.nullif(heading, F.lit("")), ignorenulls=True).over(by))
    is_heading = F.col("_l").rlike(r"^#{1,6}\s+.+$")
    cell, define, bullet = r"^\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|?\s*$", r"^([A-Za-z][^:]{1,60}):\s+(.{2,})$", r"^[-*]\s+(.+)$"
    get = lambda c, p, g: F.trim(F.regexp_extract(c, p, g))
    item = F.regexp_extract("_l", bullet, 1)
    isa = r"(?i)^([A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*)*)\s+is\s+(?:a|an|the)\s+([a-zA-Z][A-Za-z0-9]*(?:\s+[a-zA-Z][A-Za-z0-9]*)*)"
    plain = lambda v: ~v.rlike(r"https?://|^\d{4}-\d{2}|^[0-9]")
    one = lambda s, p, o, c: F.array(F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.lit(c).alias("confidence")))
    none = F.array().cast("array<struct<subject:string,predicate:string,object:string,confidence:double>>")
    is_cell = F.col("_l").rlike(cell)
    a, b = get("_l", cell, 1), get("_l", cell, 2)
    k, v = get("_l", define, 1), get("_l", define, 2)
    bk, bv = get(item, define, 1), get(item, define, 2)
    section = F.when(F.col("_h").isNotNull(), one(k, "belongs_to_section", F.col("_h"), 0.6)).otherwise(none)
    found = (
        F.when(is_heading, one(heading, "is_section", F.lit("document"), 0.5))
        .when(is_cell, F.when(~a.rlike("^[-:]+$") & ~b.rlike("^[-:]+$"), one(a, "related_to", b, 0.65)).otherwise(none))
        .when(F.col("_l").rlike(define), F.when(plain(v), F.concat(one(k, "defined_as", v, 0.8), section)).otherwise(none))
        .when(F.col("_l").rlike(bullet) & item.rlike(isa), one(get(item, isa, 1), "is_a", get(item, isa, 2), 0.8))
        .when(F.col("_l").rlike(bullet) & item.rlike(define) & plain(bv), one(bk, "defined_as", bv, 0.75))
        .otherwise(none)
    )
    out = rows.select(id_col, "line", F.posexplode(found).alias("_p", "t")).select(id_col, "line", "_p", "t.*")
    first = Window.partitionBy(id_col, F.lower("subject"), "predicate", F.lower("object")).orderBy("line", "_p")
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_p")


def entities_in(text: Column) -> Column:
    """Names in a text: runs of capitalised words, single ones within a sentence, quoted terms and
    abbreviations, in that order; of those equal but for case the first."""
    get = lambda p, g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    found = F.concat(
        get(r"\b([A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+)+)\b", 1), get(r"(?<=[a-z,;]\s)([A-Z][a-z]{2,})\b", 1), get("[\"']([^\"']{2,50})[\"']", 1), get(r"\b([A-Z]{2,})\b", 1)
    )
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, entity, pos) of each text, first occurrence of each name, case ignored."""
    rows = docs.select(id_col, F.posexplode(entities_in(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "entity"))
    return rows.groupBy(id_col, F.lower("entity").alias("_k")).agg(F.min_by("entity", "pos").alias("entity"), F.min("pos").alias("pos")).drop("_k")


def resolve(found: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of triples: an entity for each normalised name, named as it is written first;
    its id is a hash of the name. Relations keep repetitions."""
    sides = found.select(*order, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("subject").alias("name")), F.struct(F.lit(1).alias("side"), F.col("object").alias("name")))).alias("x"))
    named = sides.select(T.normalised_name(F.col("x.name")).alias("key"), F.col("x.name").alias("name"), F.struct(*order, "x.side").alias("at"))
    nodes = named.groupBy("key").agg(F.min_by("name", "at").alias("canonical_name"), F.array_sort(F.collect_set("name")).alias("aliases"), F.count("*").alias("mentions"))
    nodes = nodes.select(F.sha2("key", 256).alias("entity_id"), "key", "canonical_name", F.array_except("aliases", F.array("canonical_name")).alias("aliases"), "mentions")
    key = lambda c: F.sha2(T.normalised_name(F.col(c)), 256)
    edges = found.select(*order, key("subject").alias("subject_id"), "predicate", key("object").alias("object_id"), "confidence")
    return nodes, edges


def neighbours(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(src, predicate, dst, level) of the edges (src, predicate, dst) met by going out from the start
    nodes (node) breadth first; a node is gone out from once, edges to visited ones count."""
    links = checkpointed(edges.select("src", "predicate", "dst"))
    seen = checkpointed(start.select("node").distinct())
    front, out = seen, None
    for level in range(1, depth + 1):
        met = checkpointed(links.join(front.withColumnRenamed("node", "src"), "src").withColumn("level", F.lit(level)))
        out = met if out is None else out.unionByName(met)
        front = checkpointed(met.select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            break
        seen = checkpointed(seen.union(front))
    return out.select("src", "predicate", "dst", "level")


def linked(found: DataFrame, order: list[str]) -> DataFrame:
    """(entity, triples) of each name, under subject and object."""
    rows = found.select(F.explode(F.array("subject", "object")).alias("entity"), F.struct(*order, "subject", "predicate", "object").alias("t"))
    return rows.groupBy("entity").agg(F.count("*").alias("n_triples"), F.min("t").alias("first"))


def trace_tree(spans: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, root, depth, path) of spans by their parents; a span whose parent is not there is a root."""
    known = spans.select(F.col(id_col).alias("i"), F.col(parent_col).alias("p"))
    roots = known.join(known.select(F.col("i").alias("p")).distinct(), "p", "left_anti").select("i", F.col("i").alias("root"), F.lit(0).alias("depth"), F.col("i").cast("string").alias("path"))
    out, front = checkpointed(roots), None
    front = out
    while True:
        nxt = known.join(front.select(F.col("i").alias("p"), "root", "depth", "path"), "p").select("i", "root", (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", F.col("i").cast("string")).alias("path"))
        front = checkpointed(nxt)
        if front.isEmpty():
            return out.withColumnRenamed("i", id_col)
        out = out.union(front)


def cypher_node(entity_id: Column, name: Column, kind: Column) -> Column:
    escaped = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("MERGE (n:"), kind, F.lit(" {id: '"), entity_id, F.lit("'}) SET n.name = '"), escaped, F.lit("';"))


def cypher_edge(subject_id: Column, predicate: Column, object_id: Column) -> Column:
    kind = F.regexp_replace(F.upper(predicate), "[^A-Z0-9]", "_")
    return F.concat(F.lit("MATCH (a {id: '"), subject_id, F.lit("'}), (b {id: '"), object_id, F.lit("'}) MERGE (a)-[:"), kind, F.lit("]->(b);"))


def dot_lines(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """(part, line) of a DOT graph: nodes (term, frequency) by term, the most frequent highlighted, labels at
    most 40 characters, edges (src, predicate, dst) once each."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    best = nodes.orderBy(F.desc("frequency"), "term").limit(top).select("term", F.lit(True).alias("_top"))
    marked = nodes.join(F.broadcast(best), "term", "left")
    label = F.when(F.length("term") > 40, F.concat(F.substring("term", 1, 39), F.lit("…"))).otherwise(F.col("term"))
    style = F.when(F.col("_top"), F.lit(", style=filled")).otherwise(F.lit(""))
    node = marked.select(F.lit("node").alias("part"), F.concat(F.lit("  "), quote(F.col("term")), F.lit(" [label="), quote(label), style, F.lit("];")).alias("line"))
    edge = edges.select("src", "predicate", "dst").distinct().select(F.lit("edge").alias("part"), F.concat(F.lit("  "), quote(F.col("src")), F.lit(" -> "), quote(F.col("dst")), F.lit(" [label="), quote(F.col("predicate")), F.lit("];")).alias("line"))
    return node.unionByName(edge)


#: Characters of a term by which it is looked up in longer ones.
PREFIX = 8


def contained_terms(nodes: DataFrame) -> DataFrame:
    """(term, other): terms of three or more characters found inside a longer one. A term's first PREFIX
    characters, or all of a shorter one, meet the runs of that length of the others, which are as many as
    a term has characters; then the whole terms are compared."""
    terms = nodes.select("term").distinct().where(F.length("term") >= 3)
    left = terms.select("term", F.substring("term", 1, PREFIX).alias("_g"))
    runs = F.flatten(F.array(*[F.regexp_extract_all("term", F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)) for k in range(3, PREFIX + 1)]))
    right = terms.select(F.col("term").alias("other"), F.explode(F.array_distinct(runs)).alias("_g"))
    return left.join(right, "_g").where((F.length("other") > F.length("term")) & F.contains("other", "term")).select("term", "other").distinct()


#: Relations that a text states between two words: fixed values.
SAID = r"(?i)([a-z][a-z0-9_\-]+)\s+(is|has|uses|contains|belongs_to|related_to|part_of)\s+([a-z][a-z0-9_\-]+)"


def said(rows: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """(keep, position, subject, predicate, object, confidence) of the relations that a text states, lower-cased, in
    their order; they don't overlap. Null texts state none."""
    get = lambda g: F.regexp_extract_all(F.col(text_col), F.lit(SAID), F.lit(g))
    found = rows.select(*keep, F.posexplode(F.arrays_zip(get(1).alias("s"), get(2).alias("p"), get(3).alias("o"))).alias("position", "x"))
    return found.select(*keep, "position", F.lower("x.s").alias("subject"), F.lower("x.p").alias("predicate"), F.lower("x.o").alias("object"), F.lit(0.85).alias("confidence"))


def enriched(nodes: DataFrame, edges: DataFrame, least: float = 0.5) -> DataFrame:
    """(subject, predicate, object, confidence) that a taxonomy implies: what terms say (0.85), parents
    (0.9), containment (0.7) and edges (0.75). nodes: (term, parent); edges: (src, predicate, dst)."""
    spoken = said(nodes, "term").drop("position")
    known = nodes.select(F.col("term").alias("object")).distinct()
    up = nodes.select(F.col("term").alias("subject"), F.lit("is_a").alias("predicate"), F.col("parent").alias("object"), F.lit(0.9).alias("confidence")).join(known, "object", "left_semi")
    inside = contained_terms(nodes).select(F.col("term").alias("subject"), F.lit("part_of").alias("predicate"), F.col("other").alias("object"), F.lit(0.7).alias("confidence"))
    tied = edges.where("src <> dst").select(F.col("src").alias("subject"), F.lit("related_to").alias("predicate"), F.col("dst").alias("object"), F.lit(0.75).alias("confidence")).join(known, "object", "left_semi")
    tied = tied.join(nodes.select(F.col("term").alias("subject")).distinct(), "subject", "left_semi")
    cols = ["subject", "predicate", "object", "confidence"]
    return spoken.select(cols).union(up.select(cols)).union(inside.select(cols)).union(tied.select(cols)).where(F.col("confidence") >= least)


def merged_taxonomies(left: DataFrame, right: DataFrame) -> DataFrame:
    """(term, frequency, parent, children) of two taxonomies: frequencies added, the left one's parent if it
    has one, children of both."""
    r = right.select("term", F.col("frequency").alias("f2"), F.col("parent").alias("p2"), F.col("children").alias("c2"))
    none = F.array().cast("array<string>")
    return left.join(r, "term", "full_outer").select(
        "term", (F.coalesce("frequency", F.lit(0)) + F.coalesce("f2", F.lit(0))).alias("frequency"), F.coalesce("parent", "p2").alias("parent"),
        F.array_sort(F.array_union(F.coalesce("children", none), F.coalesce("c2", none))).alias("children"),
    )


def term_jsonld(term: Column, frequency: Column, parent: Column) -> Column:
    """A DefinedTerm of schema.org as JSON text; a null parent is left out."""
    return F.to_json(F.struct(F.lit("DefinedTerm").alias("@type"), term.alias("name"), frequency.alias("frequency"), parent.alias("broader")))
