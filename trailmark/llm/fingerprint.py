"""Merkle fingerprints of documents: a tree of paragraphs and sections, in DataFrame functions only.

Both are cut by content, so an insertion changes the branches it falls into and moves the others: a paragraph ends with
its line, or in a line after a word that ends in one of CUTS; a section ends after a paragraph whose digest begins with
one of two of the sixteen hexadecimal digits.  A section's digest is that of its paragraphs' digests, the root that of
the sections'.  Paragraphs hold every character of the text, so equal roots mean equal texts.

The fingerprint is the root.  The likeness of two trees is the share of nodes (paragraphs, sections and root, each
distinct digest once) that both have: twice the common ones by those of both, 1 only for equal roots.  No node is left
out, however long the text.  ``differing`` walks down from unequal roots: sections that the other tree lacks, and in
them the paragraphs that it lacks.

Null texts count as empty; an empty text has no paragraphs, is like other empty ones (1.0) and like nothing else (0.0).
Repeated rows give repeated rows.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, with_next

#: Last characters of a word after which a line is cut.
CUTS = ".!?;:,sy"
PARAGRAPH = f"[^\\n]*?[{CUTS}](?:[ \\t\\r]+|\\n|\\z)|[^\\n]*\\n|[^\\n]+"
SECTION = "(?:[0-9a-f]{16},)*?[01][0-9a-f]{15},|(?:[0-9a-f]{16},)+"


def _digest(x: Column) -> Column:
    return F.substring(F.md5(x.cast("binary")), 1, 16)


def tree(text: Column) -> dict[str, Column]:
    """paragraphs and sections (arrays of digests, in order) and root, digests in hexadecimal."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    joined = F.array_join(F.transform(parts, _digest), ",")
    # the joined digests as a lambda's variable, so that they are made once
    made = F.transform(F.array(joined), lambda p: F.struct(F.filter(F.split(p, ","), lambda x: x != "").alias("paragraphs"), F.transform(F.regexp_extract_all(F.concat(p, F.lit(",")), F.lit(SECTION), F.lit(0)), _digest).alias("sections")))[0]
    made = F.transform(F.array(made), lambda t: F.struct(t["paragraphs"].alias("paragraphs"), t["sections"].alias("sections"), F.md5(F.array_join(t["sections"], ",").cast("binary")).alias("root")))[0]
    return {name: made[name] for name in ("paragraphs", "sections", "root")} | {"tree": made}


def nodes(tree: Column) -> Column:
    return F.array_distinct(F.concat(tree["paragraphs"], tree["sections"], F.array(tree["root"])))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two trees."""
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(nodes(a), nodes(b))) / (F.size(nodes(a)) + F.size(nodes(b))))


def first_lost(a: Column, b: Column) -> Column:
    """0-based position of the first digest of array a that array b lacks, or null; in time linear in both."""
    gone = F.array_except(a, b)
    return F.when(F.size(gone) > 0, F.array_position(a, F.get(gone, F.lit(0))) - 1)


def document_trees(docs: DataFrame) -> DataFrame:
    """doc_id and tree, a struct of paragraphs, sections and root."""
    return docs.select("doc_id", tree(F.col("text"))["tree"].alias("tree"))


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Where two versions of documents differ: (doc_id, side, part, position) of each section and paragraph that the other side lacks.

    doc_ids are distinct on each side; side is left or right, part section or paragraph, position 0-based.  A document
    that only one side has is no edit and doesn't appear; equal roots end the comparison at once.  A version in which
    parts only change places or number has unequal roots and no rows.
    """
    a, b = document_trees(left).alias("a"), document_trees(right).alias("b")
    both = a.join(b, "doc_id").where("a.tree.root <> b.tree.root")
    parts = [F.struct(F.lit(side).alias("side"), F.lit(part).alias("part"), F.col(f"{x}.tree.{part}s").alias("own"), F.array_except(f"{x}.tree.{part}s", f"{y}.tree.{part}s").alias("gone")) for side, x, y in (("left", "a", "b"), ("right", "b", "a")) for part in ("section", "paragraph")]
    rows = both.select("doc_id", F.inline(F.array(*parts))).where(F.size("gone") > 0)
    own = rows.select("doc_id", "side", "part", F.posexplode("own").alias("position", "digest"))
    gone = rows.select("doc_id", "side", "part", F.explode("gone").alias("digest"))
    return own.join(gone, ["doc_id", "side", "part", "digest"], "left_semi").select("doc_id", "side", "part", "position")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the text with its last half replaced by the next document's start, their likeness, and the text's branches that the edit touched.

    edited_sections: how many distinct sections of the text the edited text lacks; edited_from: position of its first such paragraph.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), tree(F.col("text"))["tree"].alias("tree"))
    rows = with_next(rows, [F.coalesce("doc_id", F.lit(NO_ID)), F.col("text")], ["text", "tree"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.col("next_text").substr(F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_tree", tree(F.col("edited"))["tree"])
    own, new = F.col("tree"), F.col("edited_tree")
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        own["root"].alias("fingerprint"), new["root"].alias("edited_fingerprint"), likeness(own, new).alias("near_edited"), likeness(own, F.col("next_tree")).alias("near_next"),
        F.size(F.array_except(own["sections"], new["sections"])).cast("long").alias("edited_sections"), first_lost(own["paragraphs"], new["paragraphs"]).alias("edited_from"),
    )


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_PARAGRAPH = rf"[^\n]*?[{CUTS}](?:[ \t\r]+|\n|\z)|[^\n]*\n|[^\n]+"

OP7_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, text, coalesce(lead(text) over (order by doc_id nulls last, text), first_value(text) over (order by doc_id nulls last, text)) as nt from d),
v as (select doc_id, text, nt, substr(text, 1, length(text) - length(text) // 2) || substr(nt, 1, length(text) // 2) as edited from n),
u as (select distinct t from (select text as t from v union all select edited from v)),
l as (select t, list_transform(regexp_extract_all(t, '{_PARAGRAPH}'), lambda x: substr(md5(x), 1, 16)) as p from u),
s as (select t, p, list_transform(regexp_extract_all(array_to_string(p, ',') || ',', '{SECTION}'), lambda x: substr(md5(x), 1, 16)) as s from l),
r as (select t, p, s, md5(array_to_string(s, ',')) as root from s),
f as (select *, list_distinct(list_concat(p, s, [root])) as nodes from r)
select doc_id, cast(length(v.text) as bigint) as n_chars, sha256(v.edited) as edited_sha256, a.root as fingerprint, b.root as edited_fingerprint,
 case when a.root = b.root then 1.0 else 2 * len(list_intersect(a.nodes, b.nodes)) / (len(a.nodes) + len(b.nodes)) end::double as near_edited,
 case when a.root = c.root then 1.0 else 2 * len(list_intersect(a.nodes, c.nodes)) / (len(a.nodes) + len(c.nodes)) end::double as near_next,
 cast(len(list_filter(list_distinct(a.s), lambda x: not list_contains(b.s, x))) as bigint) as edited_sections,
 cast(list_filter(list_transform(a.p, lambda x, i: case when not list_contains(b.p, x) then i - 1 end), lambda x: x is not null)[1] as bigint) as edited_from
from v join f a on a.t = v.text join f b on b.t = v.edited join f c on c.t = v.nt
"""
