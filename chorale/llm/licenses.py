"""Licence scan: ordered signature rules in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import keyed_texts
from chorale.llm.license_rules import gate, rules

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
LEVELS = 4
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule_array() -> str:
    each = ", ".join(f"named_struct('p', {p}, 'l', {_quoted(l)}, 'c', {c}D, 'k', {_quoted(k)}, 'r', {_quoted(r)})" for p, l, c, k, r in rules())
    return f"array({each})"


def _spaces(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))


def detections() -> str:
    """SQL for the detections in ``norm``: start, end, priority, label, confidence.

    A rule runs where its keyword occurs.  Places come from what its regex
    extracts and what splitting by it leaves between.
    """
    # ends are running sums: those of whole parts of 64 first, then the few steps in a place's own part;
    # arrays are bound to a name in one-element arrays, as lambdas evaluate whatever else they hold anew
    total = "aggregate(sequence({a}, {b}), 0, (n, j) -> n + {of}[j])"
    one = f"""flatten(transform(
      array(named_struct('g', transform(split(norm, r.r, -1), x -> length(x)), 'm', transform(regexp_extract_all(norm, r.r, 0), x -> length(x)))),
      v -> if(size(v.m) = 0, cast(array() as array<struct<s:int,n:int,p:int,l:string,c:double>>), flatten(transform(
        array(named_struct('g', v.g, 'm', v.m, 'ends', transform(sequence(0, (size(v.m) - 1) div 64), q ->
          {total.format(a="64 * q", b="least(64 * q + 63, size(v.m) - 1)", of="v.g")} + {total.format(a="64 * q", b="least(64 * q + 63, size(v.m) - 1)", of="v.m")}))),
        w -> flatten(transform(
          array(named_struct('g', w.g, 'm', w.m, 'before', transform(sequence(0, size(w.ends) - 1), q -> {total.format(a="0", b="q", of="w.ends")} - w.ends[q]))),
          u -> transform(
            transform(u.m, (m, i) -> u.before[i div 64] + {total.format(a="i - i % 64", b="i", of="u.g")} + {total.format(a="i - i % 64", b="i", of="u.m")}),
            (e, i) -> named_struct('s', e - u.m[i], 'n', -e, 'p', r.p, 'l', r.l, 'c', r.c)))))))))"""
    keys = ", ".join(_quoted(k) for k in sorted({k for *_, k, _ in rules()}))
    return f"flatten(flatten(transform(array(filter(array({keys}), k -> contains(norm, k))), here -> transform(filter({_rule_array()}, r -> array_contains(here, r.k)), r -> {one}))))"


def resolved(found: str) -> str:
    """SQL for what stays of the detections: labels, count, doubt and spans.

    In order of start, then length, then priority, a detection goes if one
    before it of the same or a higher priority reaches at least as far: its
    interval contains this one's.  The state is one reach per priority.
    """
    ends = ", ".join(f"'e{k}', 0" for k in range(1, LEVELS + 1))
    inside = " or ".join(f"(d.p >= {k} and a.e{k} >= -d.n)" for k in range(1, LEVELS + 1))
    reach = ", ".join(f"'e{k}', if(d.p = {k}, greatest(a.e{k}, -d.n), a.e{k})" for k in range(1, LEVELS + 1))
    return f"""aggregate(array_sort({found}),
      named_struct({ends}, 'labels', cast(array() as array<string>), 'kept', 0, 'doubt', 1.0D),
      (a, d) -> if({inside}, a, named_struct({reach}, 'labels', array_union(a.labels, array(d.l)), 'kept', a.kept + 1, 'doubt', a.doubt * (1 - d.c))))"""


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence phrases and detections of every row of ``docs``.

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score
    and n_detections.  Texts are folded to lower-case words of ASCII digits,
    letters and non-ASCII characters.  The base places are those of three
    phrases; the rules of :mod:`license_rules` add labels, after priorities
    and interval containment have resolved overlaps.  The score is the chance
    that one of the kept detections is right, taken as independent.

    Null and empty texts have no words, no places and score 0; equal places of
    one label count once for each rule; other columns are not read; an empty
    table gives no rows; rows, repeated ones too, come back one for one.  All
    of it is projections: no shuffle, no Python.  Texts without any keyword
    skip the rules, and a text's hits cost time in proportion to their number.
    """
    separators = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    norm = keyed_texts(docs, doc_id, text).select("doc_id", F.regexp_replace(F.concat(F.lit(" "), F.translate("text", _UPPER, _UPPER.lower()), F.lit(" ")), separators, " ").alias("norm"))
    phrases = "|".join(PHRASES)
    some = F.lit(False)
    for keyword in gate():
        some = some | F.contains("norm", F.lit(keyword))
    has = {label: F.contains("norm", F.lit(f" {phrase} ")) for phrase, label in PHRASES.items()}
    counted = norm.select("doc_id", "norm", (_spaces(F.col("norm")) - 1).cast("long").alias("n_words"), some.alias("gate"))
    parts = F.when(F.contains("norm", F.lit(" license ")), F.split("norm", f" (?=(?:{phrases}) )", -1))
    state = F.expr(f"if(gate, {resolved(detections())}, null)")
    base = F.when(F.contains("norm", F.lit(" license ")), F.array_compact(F.array(*[F.when(has[x], F.lit(x)) for x in sorted(has)]))).otherwise(F.array().cast("array<string>"))
    found = counted.select("doc_id", "n_words", parts.alias("parts"), state.alias("state"), base.alias("base"))
    n_base = F.coalesce(F.size("parts") - 1, F.lit(0))
    n_base = F.when(F.col("parts").isNull(), 0).otherwise(n_base)
    return found.select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"),
        F.when(n_base > 0, _spaces(F.get("parts", F.lit(0)))).cast("long").alias("first_word"),
        F.when(n_base > 0, F.col("n_words") - _spaces(F.element_at("parts", -1))).cast("long").alias("last_word"),
        F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", F.coalesce("state.labels", F.array().cast("array<string>"))))).alias("labels"),
        (1 - F.coalesce("state.doubt", F.lit(1.0))).alias("score"),
        F.coalesce("state.kept", F.lit(0)).cast("long").alias("n_detections"),
    )
