"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts are brought to templates: numbers, names (capitalised words inside a sentence) and units after a number become
typed placeholders, case and punctuation go.  Windows of five template words of the benchmark are joined by hash with
those of all documents; a window with a name has a second hash with its names as plain words, so a copy in another
case is found as well.  Matches on one alignment (document position less item position) are one copy of the item.  Its
slots must be consistent: wherever the item repeats a value, the copy repeats its own; of a copy that isn't, only the
windows that are equal word for word count.  A template that stands over 20 times in one item, as in a table of
numbers, can't be aligned: such windows count where the document holds the same five words; so no template meets a
document's windows more than 20 times an item.  A document leaks an item if its copies cover 0.8 or more of the item's
distinct window positions; ``reparameterised`` tells whether a slot of a consistent copy differs.

The benchmark's windows are broadcast only if they number at most ``most_broadcast``; else Spark joins both sides by
shuffle.  Null texts have no windows; items of under five words have none and never match.  Each row is judged by
itself, also those that share a doc_id or have none; a doc_id's row with the most matches speaks for it.  Repeated items
are items; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOW = 5
COVERAGE = 0.8
#: A template that stands more often in an item isn't aligned.
MOST = 20
MARK = "§"
#: Unit words that may follow a number: fixed values.
UNITS = "kilometers|kilometres|kilograms|centimeters|millimeters|meters|metres|miles|feet|inches|grams|liters|litres|pounds|ounces|seconds|minutes|hours|days|weeks|months|years|percent|dollars|euros|cents|degrees|km|kg|cm|mm|mg|ml|lb|oz|ft|mph|kmh|ms|min|hrs"
NAME = r"([\p{Ll}\p{Nd},;:] )(\p{Lu}\p{Ll}+)"
NUMBER = r"([0-9]+(?:[.,][0-9]+)*)"
DROPPED = ".,;:!?\"'()[]{}*#$%&|<>/\\_~`^+=@-"


def marked(text: Column) -> Column:
    """Text in lower case without punctuation, its numbers, names and units marked."""
    x = F.translate(text, MARK, "")
    for _ in range(2):  # names in a row take two passes
        x = F.regexp_replace(x, NAME, f"$1{MARK}m$2")
    x = F.regexp_replace(x, NUMBER, f"{MARK}n$1")
    x = F.regexp_replace(x, f"({MARK}n[0-9.,]+ )({UNITS})([^a-z]|$)", f"$1{MARK}u$2$3")
    return F.lower(F.translate(x, DROPPED, ""))


def words(marks: Column) -> Column:
    return F.filter(F.split(marks, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")


def template(word: Column) -> Column:
    slots = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, f"{MARK}n[0-9]+", "<n>"), f"{MARK}m\\p{{Ll}}+", "<m>"), f"{MARK}u[a-z]+", "<u>")
    return F.when(F.contains(word, F.lit(MARK)), slots).otherwise(word)


def windows(table: DataFrame, key: str) -> DataFrame:
    """(key, row, pos, h, slots, named): rows of a window; slots has its five marked words if one of them holds a placeholder.

    row is a hash of the text.  A window with names has two rows: with a placeholder for each name, and (named) with
    the names as plain words, in slots too.
    """
    t = table.select(key, F.xxhash64("text").alias("row"), marked(F.col("text")).alias("_m"))
    t = t.select(key, "row", F.contains("_m", F.lit(MARK)).alias("_any"), F.contains("_m", F.lit(f"{MARK}m")).alias("_names"), words(F.col("_m")).alias("_w"))
    # kept as hashes of words: those of plain names only where there are names
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(F.when(F.col("_any"), template(x)).otherwise(x)))
    t = t.withColumn("_h", hashed(F.col("_w"))).withColumn("_p", F.when(F.col("_names"), F.transform("_w", lambda x: F.replace(x, F.lit(f"{MARK}m"), F.lit("")))))
    t = t.withColumn("_g", F.when(F.col("_names"), hashed(F.col("_p"))))

    over = lambda h, i: F.xxhash64(*[F.element_at(h, i + j) for j in range(WINDOW)])
    row = lambda i, h, own, named: F.struct(i.alias("pos"), over(h, i).alias("h"), F.when(F.contains(own, F.lit(MARK)), own).alias("slots"), F.lit(named).alias("named"))
    joined = lambda w, i: F.array_join(F.slice(w, i, F.lit(WINDOW)), " ")
    first = lambda i: row(i, "_h", F.when(F.col("_any"), joined("_w", i)), False)
    # texts with names: the windows that hold one have a second row
    both = lambda i: F.when(F.contains(joined("_w", i), F.lit(f"{MARK}m")), F.array(first(i), row(i, "_g", joined("_p", i), True))).otherwise(F.array(first(i)))
    places = F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1))
    made = F.when(F.size("_w") >= WINDOW, F.when(F.col("_names"), F.flatten(F.transform(places, both))).otherwise(F.transform(places, first)))
    # the outer form, as for the inner one Spark infers a filter that repeats all of the above for every element
    return t.select(key, "row", made.alias("_x")).select(key, "row", F.inline_outer("_x")).where("h is not null")


def leaking_rows(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, most_broadcast: int = 500_000) -> DataFrame:
    """leaks() for each text: (doc_id, row, item_id, matched, windows, reparameterised), row being xxhash64(text)."""
    items = windows(benchmark.where("item_id is not null"), "item_id").toDF("item_id", "irow", "ipos", "h", "islots", "inamed")
    sizes = items.groupBy("item_id").agg(F.countDistinct("ipos").alias("windows"))
    often = (F.count(F.lit(1)).over(Window.partitionBy("item_id", "h")) > MOST).cast("int")
    items = items.withColumn("_often", often).withColumn("often", F.max("_often").over(Window.partitionBy("item_id", "ipos")) > 0).drop("_often")
    small = benchmark.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    hint = F.broadcast if small <= most_broadcast else lambda x: x
    found = windows(docs, "doc_id").join(hint(items.where("not often")), "h").withColumn("shift", F.col("pos") - F.col("ipos"))
    # a pair for each word in which one side has a placeholder; plain names against plain words agree as they are
    pairs = F.filter(F.arrays_zip(F.split("islots", " ").alias("a"), F.split("slots", " ").alias("b")), lambda p: F.contains(p["a"], F.lit(MARK)))
    same = F.col("islots").eqNullSafe(F.col("slots"))
    found = found.select("doc_id", "row", "item_id", "ipos", "shift", F.when(F.col("islots").isNotNull(), pairs).alias("pairs"), F.when(same, F.col("ipos")).alias("verbatim"))
    copies = found.groupBy("doc_id", "row", "item_id", "shift").agg(F.collect_set("ipos").alias("at"), F.collect_set("verbatim").alias("verbatim"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) == F.size("pairs")
    copies = copies.select("doc_id", "row", "item_id", F.when(consistent, F.col("at")).otherwise(F.col("verbatim")).alias("at"), (consistent & F.exists("pairs", lambda p: p["a"] != p["b"])).alias("other"))
    hits = copies.select("doc_id", "row", "item_id", F.explode("at").alias("ipos"), "other")
    words_of = lambda h, slots: F.when(F.col(slots).isNull(), F.col(h)).otherwise(F.xxhash64(slots))
    unaligned = items.where("often and not inamed").select("item_id", "ipos", words_of("h", "islots").alias("words"))
    if not unaligned.isEmpty():
        own = windows(docs, "doc_id").where("not named").select("doc_id", "row", words_of("h", "slots").alias("words"))
        own = own.join(hint(unaligned.select("words").distinct()), "words", "left_semi").distinct()
        hits = hits.unionByName(own.join(hint(unaligned), "words").select("doc_id", "row", "item_id", "ipos", F.lit(False).alias("other")))
    judged = hits.groupBy("doc_id", "row", "item_id").agg(F.countDistinct("ipos").alias("matched"), F.max("other").alias("reparameterised"))
    judged = judged.join(hint(sizes), "item_id").where(F.col("matched") >= coverage * F.col("windows"))
    return judged.select("doc_id", "row", "item_id", "matched", "windows", "reparameterised")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, most_broadcast: int = 500_000) -> DataFrame:
    """(doc_id, item_id, matched, windows, coverage, reparameterised): one row per document and item that it leaks."""
    rows = leaking_rows(docs, benchmark, coverage, most_broadcast)
    # the most matches, then one without a slot that differs
    best = F.min(F.struct((-F.col("matched")).alias("less"), F.col("reparameterised").alias("other"), "windows")).alias("_b")
    rows = rows.groupBy("doc_id", "item_id").agg(best)
    matched = -F.col("_b.less")
    return rows.select("doc_id", "item_id", matched.alias("matched"), "_b.windows", (matched / F.col("_b.windows")).alias("coverage"), F.col("_b.other").alias("reparameterised"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_MARKED = "translate(text, '§', '')"
for _ in range(2):
    _MARKED = rf"regexp_replace({_MARKED}, '{NAME}', '\1§m\2', 'g')"
_MARKED = rf"regexp_replace({_MARKED}, '{NUMBER}', '§n\1', 'g')"
_MARKED = rf"regexp_replace({_MARKED}, '(§n[0-9.,]+ )({UNITS})([^a-z]|$)', '\1§u\2\3', 'g')"
_MARKED = "lower(translate({}, '{}', ''))".format(_MARKED, DROPPED.replace("'", "''"))

OP9_SQL = rf"""
with t as (select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark where item_id is not null),
u as (select distinct kind, id, text from t),
w as (select kind, id, text, regexp_extract_all({_MARKED}, '[^\x20\x09-\x0D]+') as ws from u),
y as (select kind, id, text, false as named, ws from w union all select kind, id, text, true, list_transform(ws, lambda x: replace(x, '§m', '')) from w where list_bool_or(list_transform(ws, lambda x: contains(x, '§m')))),
a as (select *, list_transform(ws, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '§n[0-9]+', '<n>', 'g'), '§m\p{{Ll}}+', '<m>', 'g'), '§u[a-z]+', '<u>', 'g')) as ts from y),
k as (select w.kind, w.id, w.text, i, list_bool_or(list_transform(ws[i : i + 4], lambda x: contains(x, '§m'))) as names from w, unnest(generate_series(1, len(ws) - 4)) as g(i)),
p as (select a.kind, a.id, a.text, a.named, i, array_to_string(ts[i : i + 4], ' ') as k, ws[i : i + 4] as own from a join k on a.kind = k.kind and a.id is not distinct from k.id and a.text = k.text where not named or names),
z as (select id, count(distinct i) as windows from p where kind = 'b' group by id),
m as (select *, count(*) over (partition by id, k) > 20 as o from p where kind = 'b'),
b as (select *, bool_or(o) over (partition by id, i) as often from m),
f as (select d.id as doc_id, d.text, b.id as item_id, b.i as ipos, d.i - b.i as shift, b.own as x, d.own as y from p d join b on d.k = b.k and d.kind = 'd' and not often),
s as (select distinct doc_id, text, item_id, shift, x[j] as a, y[j] as b from f, unnest(generate_series(1, 5)) as g(j) where contains(x[j], '§')),
v as (select doc_id, text, item_id, shift, count(distinct a) = count(*) as consistent, bool_or(a <> b) as other from s group by all),
c as (select f.doc_id, f.text, f.item_id, f.ipos, coalesce(other, false) and coalesce(consistent, true) as other, coalesce(consistent, true) or x = y as counts from f left join v on f.doc_id is not distinct from v.doc_id and f.text = v.text and f.item_id = v.item_id and f.shift = v.shift),
h as (select doc_id, text, item_id, ipos, other from c where counts union all select distinct d.id, d.text, b.id, b.i, false from p d join b on d.own = b.own and d.kind = 'd' and not d.named and not b.named and often),
j as (select doc_id, text, item_id, count(distinct ipos) as matched, bool_or(other) as reparameterised from h group by all),
r as (select doc_id, item_id, matched, windows, reparameterised, row_number() over (partition by doc_id, item_id order by matched desc, reparameterised) as n from j join z on z.id = item_id where matched >= 0.8 * windows)
select doc_id, item_id, matched, windows, matched / windows as coverage, reparameterised from r where n = 1
"""
