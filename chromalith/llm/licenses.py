"""Licence scans by ordered signature rules: DataFrame operations only.

A text is normalised to words (`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased) with one space between. Every rule
has anchors, the plain words that its signature can start with. The places of anchors are found in one pass over the words; at each a window of
license_rules.WINDOW words, more than any signature has, is held against the regexes of that anchor alone, and of these against those
alone whose keyword the window has. So cost follows the number of anchors, and texts of any length are read to their end.

What is found are intervals of words. Of overlapping ones those go that lie within another one of the same or a higher
priority (of equal intervals of one priority the rule that is first in the table stays); intervals that overlap without one
holding the other both stay. In the order (first word, last word descending, priority descending, rule) every interval
comes after all that hold it, so one fold with the furthest end so far of each priority decides. Base phrases always stay.

A null text counts as empty; an empty text has no words, no labels and the score 0. Rows are told apart by nothing
but themselves: null or repeated identifiers and repeated rows each give a row. An empty table gives no rows. Only the
identifier and the text are read, whatever other columns are called. There is no shuffle.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromalith.llm.license_rules import CONFIDENCE, RULES, WINDOW, Rule

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
FOUND = "struct<first_word:int,before:int,below:int,rule:int,label:string,priority:int,base:boolean,confidence:double,last_word:int,matched:string>"
BLOCK = 256
TOP = max(CONFIDENCE)


def normalised(text: Column) -> Column:
    """The words of a text, each between two spaces; a space alone if it has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), NOT_WORD, " ")


def rule_map(rules: tuple[Rule, ...]) -> Column:
    """Anchor to its rules, a literal."""
    by: dict[str, list[Rule]] = {}
    for r in rules:
        for a in r.anchors:
            by.setdefault(a, []).append(r)
    row = lambda r: F.struct(
        F.lit(r.number).alias("rule"),
        F.lit(r.label).alias("label"),
        F.lit(r.priority).alias("priority"),
        F.lit(r.base).alias("base"),
        F.lit(CONFIDENCE[r.priority]).alias("confidence"),
        F.lit(f" {r.keyword} " if r.keyword else "").alias("keyword"),
        F.lit(f"^ (?:{r.regex}) ").alias("regex"),
    )
    return F.create_map(*[x for a, rs in by.items() for x in (F.lit(a), F.array(*[row(r) for r in rs]))])


def matches(places: Column, rules: tuple[Rule, ...]) -> Column:
    """Every match at places (word, at, window), ordered as the module says."""
    table = rule_map(rules)

    def at(p: Column) -> Column:
        gated = F.filter(F.element_at(table, p["word"]), lambda r: F.contains(p["window"], r["keyword"]))
        return F.transform(gated, lambda r: interval(p, r, F.call_function("regexp_extract", p["window"], r["regex"], F.lit(0))))

    def interval(p: Column, r: Column, text: Column) -> Column:
        last = p["at"] + F.length(text) - F.length(F.replace(text, F.lit(" "))) - 2
        return F.struct(
            p["at"].alias("first_word"), (-last).alias("before"), (-r["priority"]).alias("below"), r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"),
            r["base"].alias("base"), r["confidence"].alias("confidence"), last.alias("last_word"), F.trim(text).alias("matched"),
        )

    found = F.filter(F.flatten(F.transform(places, at)), lambda m: m["matched"] != "")
    return F.sort_array(found.cast(f"array<{FOUND}>"))


def survivors(found: Column) -> Column:
    """Intervals that no other one of their priority or a higher one holds; found is sorted. Survivors are gathered by
    blocks, so that the fold copies little."""
    start = F.struct(F.array_repeat(F.lit(-1), TOP + 1).alias("ends"), F.lit(None).cast(f"array<{FOUND}>").alias("kept"))
    empty = F.expr(f"cast(array() as array<{FOUND}>)")

    def step(s: Column, m: Column) -> Column:
        stays = m["base"] | (F.element_at(s["ends"], m["priority"] + 1) < m["last_word"])
        ends = F.transform(s["ends"], lambda e, p: F.when(stays & (p <= m["priority"]), F.greatest(e, m["last_word"])).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(stays, F.concat(s["kept"], F.array(m))).otherwise(s["kept"]).alias("kept"))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0)), F.lit(BLOCK)), lambda k: F.slice(found, k + 1, BLOCK))
    whole = F.struct(start["ends"].alias("ends"), F.expr(f"cast(array() as array<array<{FOUND}>>)").alias("kept"))

    def block(s: Column, b: Column) -> Column:
        own = F.aggregate(b, F.struct(s["ends"].alias("ends"), empty.alias("kept")), step)
        return F.struct(own["ends"].alias("ends"), F.concat(s["kept"], F.array(own["kept"])).alias("kept"))

    return F.aggregate(blocks, whole, block, lambda s: F.flatten(s["kept"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id_col, n_words, found (every match), detections (those that stay): arrays of struct(first_word, last_word, rule, label,
    priority, base, confidence, matched), words counted from 0, in the order of their places."""
    anchors = sorted({a for r in rules for a in r.anchors})
    flat = docs.select(F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("flat"))
    words = flat.select("id", F.split("flat", " ").alias("words"))
    # words[k] is word k - 1: what stands before the first space is empty
    at = words.select("id", "words", F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda k: F.get("words", k).isin(anchors)).alias("at"))
    window = lambda k: F.concat(F.lit(" "), F.array_join(F.slice("words", k + 1, WINDOW), " "), F.lit(" "))
    places = at.select("id", (F.size("words") - 2).cast("long").alias("n_words"), F.transform("at", lambda k: F.struct(F.get("words", k).alias("word"), (k - 1).alias("at"), window(k).alias("window"))).alias("places"))
    found = places.select("id", "n_words", matches(F.col("places"), rules).alias("found"))
    kept = found.select("id", "n_words", "found", survivors(F.col("found")).alias("detections"))
    names = ("first_word", "last_word", "rule", "label", "priority", "base", "confidence", "matched")
    shown = lambda c: F.transform(c, lambda m: F.struct(*[m[n].alias(n) for n in names]))
    return kept.select(F.col("id").alias(id_col), "n_words", shown("found").alias("found"), shown("detections").alias("detections"))


def labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score: the digest of scan. score is the
    confidence of the best detection."""
    found = scan(docs, id_col, text_col)
    base = F.filter("found", lambda m: m["base"])
    own = found.select(F.col(f"`{id_col}`"), "n_words", "detections", F.transform(base, lambda m: m["first_word"].cast("long")).alias("at"), F.transform(base, lambda m: m["label"]).alias("base"))
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return own.select(
        F.col(f"`{id_col}`"),
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").alias("first_word"),
        F.array_max("at").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.transform("detections", lambda m: m["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda m: m["confidence"])), F.lit(0.0)).alias("score"),
    )


def labels_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same over the view `documents`, with the same rules, by joins on anchors and an anti-join of intervals."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({r.number}, {quoted(r.label)}, {r.priority}, {CONFIDENCE[r.priority]}::double, {str(r.base).lower()}, {quoted(a)}, {quoted(r.regex)})" for r in rules for a in r.anchors)
    return f"""
        with rules(rule, label, priority, confidence, base, anchor, regex) as (values {rows}),
        t as (select doc_id, row_number() over () as r, string_split(regexp_replace(' ' || translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') || ' ', '{NOT_WORD}', ' ', 'g'), ' ') as ws from documents),
        p as (select r, unnest(range(2, len(ws))) as k, ws from t),
        h as (select r, rule, label, priority, confidence, base, k - 2 as a, regexp_extract(' ' || array_to_string(ws[k:k + {WINDOW - 1}], ' ') || ' ', '^ (?:' || regex || ') ', 0) as m from p join rules on ws[k] = anchor),
        f as (select *, a + length(m) - length(replace(m, ' ', '')) - 2 as z from h where m <> ''),
        g as (select * from f x where base or not exists (select 1 from f y where y.r = x.r and y.a <= x.a and y.z >= x.z and y.priority >= x.priority
            and (y.a <> x.a or y.z <> x.z or y.priority > x.priority or y.rule < x.rule))),
        b as (select r, count(*) as n, min(a)::bigint as lo, max(a)::bigint as hi, string_agg(distinct label, ',' order by label) as ls from f where base group by r),
        s as (select r, string_agg(distinct label, ',' order by label) as ls, max(confidence) as score from g group by r)
        select doc_id, (len(ws) - 2)::bigint as n_words, coalesce(n, 0)::bigint as n_base, lo as first_word, hi as last_word, coalesce(b.ls, '') as base_labels, coalesce(s.ls, '') as labels, coalesce(score, 0.0::double) as score
        from t left join b using (r) left join s using (r)"""
