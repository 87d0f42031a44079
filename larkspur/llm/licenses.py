"""License scans with ordered signature rules, in DataFrame functions only.

A text is split into words once. The distinct keywords among them are found by hash; a document
without any word that opens the gate is decided there. The others have their words numbered in place
(" under#12  the#13  mit#14 "), so that a rule is a regular expression over words and every match carries
its interval, and a rule is tried only where its keyword is among those found. Detections are put in
order of start, then length, then priority, and one that lies within a detection of equal or better
priority is suppressed.

The rules are wordings written one by one (`wordings`), and beside them names, versions and SPDX
identifiers that follow from a table of families.

Defined cases: a null or empty text has no words, no labels and score 0. Repeated rows give
repeated results; rows with null ids are scanned like others; texts are scanned whole, however long. An
empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordings
from .common import id_and_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words of lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Words that most license texts have; a rule that needs one of them is gated by these.
LICENSE_WORDS = ("license", "licence", "licenses", "licences", "licensed", "licensee", "licensing")


@dataclass(frozen=True)
class Rule:
    """priority: 0 is best; keyword: a word without which the pattern can't match."""

    label: str
    pattern: str
    keyword: str
    priority: int
    weight: float


def word(*alternatives: str) -> str:
    """Pattern of one numbered word."""
    return f" (?:{'|'.join(alternatives)})#[0-9]+ " if len(alternatives) > 1 else f" {alternatives[0]}#[0-9]+ "


def phrase(text: str) -> str:
    return "".join(word(w) for w in text.split())


def maybe(*patterns: str) -> str:
    return f"(?:{'|'.join(patterns)})?"


def _versions(name: str, versions: str, spdx: str, short: str = "") -> list[tuple[str, str, str, str, str]]:
    """One entry (label, name, version words, spdx words, abbreviation) for each version."""
    return [(f"{spdx}-{v}".lower(), name, v.replace(".", " "), f"{spdx} {v}".lower().replace("-", " ").replace(".", " "), short or spdx.lower()) for v in versions.split()]


#: label, words of the name before "license", version words, words of the SPDX identifier, abbreviation.
FAMILIES: list[tuple[str, str, str, str, str]] = [
    ("mit", "mit", "", "mit", ""),
    ("mit-0", "mit no attribution", "", "mit 0", ""),
    ("apache-1.0", "apache software", "1 0", "apache 1 0", ""),
    ("apache-1.1", "apache software", "1 1", "apache 1 1", ""),
    ("apache-2", "apache", "2 0", "apache 2 0", ""),
    ("bsd-2-clause", "bsd 2 clause", "", "bsd 2 clause", ""),
    ("bsd-3-clause", "bsd 3 clause", "", "bsd 3 clause", ""),
    ("bsd-4-clause", "bsd 4 clause", "", "bsd 4 clause", ""),
    ("0bsd", "bsd zero clause", "", "0bsd", ""),
    ("isc", "isc", "", "isc", ""),
    ("zlib", "zlib", "", "zlib", ""),
    ("boost-1.0", "boost software", "1 0", "bsl 1 0", ""),
    ("unlicense", "the unlicense", "", "unlicense", ""),
    ("wtfpl", "do what the fuck you want to public", "2", "wtfpl", ""),
    ("postgresql", "postgresql", "", "postgresql", ""),
    ("ncsa", "university of illinois ncsa open source", "", "ncsa", ""),
    ("openssl", "openssl", "", "openssl", ""),
    ("php-3.01", "php", "3 01", "php 3 01", ""),
    ("zpl-2.1", "zope public", "2 1", "zpl 2 1", ""),
    ("ms-pl", "microsoft public", "", "ms pl", ""),
    ("ms-rl", "microsoft reciprocal", "", "ms rl", ""),
    ("bsl-1.1", "business source", "1 1", "busl 1 1", ""),
    ("sspl-1.0", "server side public", "1", "sspl 1 0", "sspl"),
    ("elastic-2.0", "elastic", "2 0", "elastic 2 0", ""),
    ("upl-1.0", "universal permissive", "1 0", "upl 1 0", ""),
    ("ofl-1.1", "sil open font", "1 1", "ofl 1 1", "ofl"),
    ("vim", "vim", "", "vim", ""),
    ("tcl", "tcl tk", "", "tcl", ""),
    ("ecl-2.0", "educational community", "2 0", "ecl 2 0", ""),
    ("cc0-1.0", "cc0", "1 0", "cc0 1 0", "cc0"),
    ("odbl-1.0", "open database", "1 0", "odbl 1 0", "odbl"),
    ("odc-by-1.0", "open data commons attribution", "1 0", "odc by 1 0", ""),
    ("pddl-1.0", "open data commons public domain dedication and", "1 0", "pddl 1 0", ""),
    *_versions("gnu general public", "1 2 3", "GPL", "gpl"),
    *_versions("gnu lesser general public", "2.1 3", "LGPL", "lgpl"),
    *_versions("gnu library general public", "2", "LGPL-library", "lgpl"),
    *_versions("gnu affero general public", "1 3", "AGPL", "agpl"),
    *_versions("gnu free documentation", "1.1 1.2 1.3", "GFDL", "gfdl"),
    *_versions("mozilla public", "1.0 1.1 2.0", "MPL"),
    *_versions("eclipse public", "1.0 2.0", "EPL"),
    *_versions("common development and distribution", "1.0 1.1", "CDDL"),
    *_versions("common public", "1.0", "CPL"),
    *_versions("european union public", "1.0 1.1 1.2", "EUPL"),
    *_versions("academic free", "1.1 1.2 2.0 2.1 3.0", "AFL"),
    *_versions("open software", "1.0 1.1 2.0 2.1 3.0", "OSL"),
    *_versions("artistic", "1.0 2.0", "Artistic"),
    *_versions("python software foundation", "2", "PSF"),
    *_versions("latex project public", "1.0 1.1 1.2 1.3", "LPPL"),
    *_versions("apple public source", "1.0 1.1 1.2 2.0", "APSL"),
    *_versions("q public", "1.0", "QPL"),
    *_versions("sun public", "1.0", "SPL"),
    *_versions("ibm public", "1.0", "IPL"),
    *_versions("netscape public", "1.0 1.1", "NPL"),
    *_versions("reciprocal public", "1.1 1.5", "RPL"),
]


def _family_rules() -> list[Rule]:
    out: list[Rule] = []
    grant = word("licensed", "released", "distributed", "available", "provided", "published", "covered") + maybe(phrase("to you")) + word("under", "by") + maybe(phrase("the terms of")) + maybe(word("the"))
    stated = maybe(word("version", "v"))
    named: set[str] = set()
    for label, name, version, spdx, short in FAMILIES:
        # the rarest word of a name is its longest one
        key = max(name.split(), key=lambda w: (len(w) if w not in ("software", "public", "general", "open", "source", "clause", "license", "what", "want") else 0, w))
        license_ = maybe(word("licen[cs]e"))
        full = phrase(name) + (license_ if version else word("licen[cs]e"))
        numbered = full + (stated + (phrase(version) if " " not in version or not version.endswith(" 0") else phrase(version[:-2]) + maybe(word("0"))) if version else "")
        glued = word("v" + version.split()[0]) if version else ""
        out.append(Rule(label, phrase("spdx license identifier") + phrase(spdx), "spdx", 0, 0.99))
        out.append(Rule(label, grant + numbered, key, 1, 0.95))
        out.append(Rule(label, numbered, key, 2, 0.85))
        if version:
            out.append(Rule(label, full + glued, key, 2, 0.85))
            family = label.rpartition("-")[0] or label
            if name not in named and family != "apache":
                named.add(name)
                out.append(Rule(family, grant + phrase(name) + word("licen[cs]e"), key, 2, 0.8))
                out.append(Rule(family, phrase(name) + word("licen[cs]e"), key, 3, 0.7))
        if short and version:
            out.append(Rule(label, word(short) + maybe(word("licen[cs]e")) + stated + phrase(version), short, 3, 0.75))
            out.append(Rule(label, word(short + "v" + version.split()[0]), short + "v" + version.split()[0], 3, 0.75))
    return out


def _creative_commons_rules() -> list[Rule]:
    out = []
    long = {"by": "attribution", "sa": "share alike", "nc": "non commercial", "nd": "no derivatives"}
    for parts in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        short, label = phrase(parts.replace("-", " ")), f"cc-{parts}"
        spelled = "".join(f"(?:{phrase(long[p])}|{word(long[p].replace(' ', ''))})" for p in parts.split("-"))
        version = "(?:" + "|".join(phrase(v) for v in ("1 0", "2 0", "2 5", "3 0", "4 0")) + ")"
        out.append(Rule(label, phrase("spdx license identifier cc") + short + version, "spdx", 0, 0.99))
        out.append(Rule(label, word("licensed", "released", "available") + word("under") + maybe(word("a", "the")) + word("cc") + short + maybe(version), "cc", 1, 0.95))
        out.append(Rule(label, word("cc") + short + version, "cc", 1, 0.9))
        out.append(Rule(label, word("cc") + short, "cc", 2, 0.7))
        out.append(Rule(label, phrase("creative commons") + spelled + maybe(version) + maybe(word("international", "unported")) + maybe(word("licen[cs]e")), "commons", 1, 0.95))
        out.append(Rule(label, phrase("creativecommons org licenses") + short + maybe(version), "creativecommons", 1, 0.95))
    return out


def _written(text: str, priority: int, weight: float) -> list[Rule]:
    """The rules of lines `label keyword wording`: a|b is either word, [a b] may be missing."""
    out = []
    for line in text.split("\n"):
        label, keyword, wording = line.split(" ", 2)
        pattern = ""
        for part in re.findall(r"\[[^]]*\]|[^\s[\]]+", wording):
            words = "".join(word(*w.split("|")) for w in part.strip("[]").split())
            pattern += maybe(words) if part.startswith("[") else words
        out.append(Rule(label, pattern, keyword, priority, weight))
    return out


WRITTEN: list[Rule] = _written(wordings.SENTENCES, 1, 0.95) + _written(wordings.HEADERS, 2, 0.85) + _written(wordings.MENTIONS, 3, 0.5)
RULES: list[Rule] = _family_rules() + _creative_commons_rules() + WRITTEN
LEVELS = 4


def required(pattern: str) -> str:
    """A pattern without its optional parts."""
    return re.sub(r"\(\?:(?:[^()]|\(\?:[^()]*\))*\)\?", "", pattern)


def gate_words() -> list[str]:
    """Every rule and base phrase needs one of these words: one of LICENSE_WORDS that its pattern has, or else its keyword."""
    out = {"mit", "apache", "cc"}
    for r in RULES:
        plain = [w for w in re.findall(" ([0-9a-z]+)#", required(r.pattern)) if w in LICENSE_WORDS]
        out.update(plain[:1] or (("license", "licence") if "licen[cs]e" in required(r.pattern) else (r.keyword,)))
    return sorted(out)


def numbered_words(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w, i: F.concat(F.lit(" "), w, F.lit("#"), i.cast("string"), F.lit(" "))), "")


def _starts(numbered: Column, text: str) -> Column:
    first, *rest = text.split()
    pattern = f" {first}#([0-9]+) " + "".join(f" {w}#[0-9]+ " for w in rest)
    return F.transform(F.regexp_extract_all(numbered, F.lit(pattern), F.lit(1)), lambda x: x.cast("long"))


def _detections(numbered: Column, present: Column) -> Column:
    # one constant, spelled as JSON: hundreds of literals would take the planner seconds
    rules = F.from_json(F.lit(json.dumps([vars(r) for r in RULES])), "array<struct<label:string,pattern:string,keyword:string,priority:int,weight:double>>")
    tried = F.filter(rules, lambda r: F.array_contains(present, r["keyword"]))

    def matches(r: Column) -> Column:
        hits = F.regexp_extract_all(numbered, r["pattern"], F.lit(0))
        return F.transform(hits, lambda x: F.struct(F.regexp_extract(x, "#([0-9]+)", 1).cast("long").alias("start"), (-F.regexp_extract(x, "^.*#([0-9]+)", 1).cast("long")).alias("minus_end"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight")))

    return F.array_sort(F.flatten(F.transform(tried, matches)))


def _kept(found: Column) -> Column:
    """Sweep in order of start: labels and best weight of the detections that none of equal or better priority contains.

    reach[p] is the largest end so far among priorities up to p.
    """
    zero = F.struct(F.array(*[F.lit(-1).cast("long")] * LEVELS).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc: Column, d: Column) -> Column:
        end = -d["minus_end"]
        free = F.element_at(acc["reach"], d["priority"] + 1) < end
        reach = F.transform(acc["reach"], lambda r, p: F.when(p >= d["priority"], F.greatest(r, end)).otherwise(r))
        return F.struct(reach.alias("reach"), F.when(free, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"), F.when(free, F.greatest(acc["score"], d["weight"])).otherwise(acc["score"]).alias("score"))

    return F.aggregate(found, zero, step)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, base places, labels and score of every whole text. One narrow pass without a shuffle."""
    literal = lambda words: F.split(F.lit(" ".join(words)), " ")
    rows = id_and_text(df, id_col, text_col).select("doc_id", F.split(F.translate("text", UPPER, LOWER), BETWEEN).alias("w"))
    # only the first and the last part may be empty
    edges = (F.element_at("w", 1) == "").cast("long") + (F.element_at("w", -1) == "").cast("long")
    rows = rows.select("doc_id", F.greatest(F.size("w") - edges, F.lit(0)).cast("long").alias("n_words"), F.when(F.arrays_overlap("w", literal(gate_words())), F.filter("w", lambda x: x != "")).alias("w"))
    rows = rows.select("doc_id", "n_words", F.coalesce(numbered_words(F.col("w")), F.lit("")).alias("numbered"), F.array_intersect("w", literal(sorted({r.keyword for r in RULES}))).alias("present"))
    some = F.col("numbered") != ""
    rows = rows.select("doc_id", "n_words", *[F.when(some, _starts(F.col("numbered"), p)).otherwise(F.array().cast("array<bigint>")).alias(label) for label, p in BASE.items()], F.when(some, _kept(_detections(F.col("numbered"), F.col("present")))).alias("kept"))
    places = F.concat(*[F.col(f"`{label}`") for label in BASE])
    base = F.filter(F.array(*[F.when(F.size(F.col(f"`{label}`")) > 0, F.lit(label)) for label in sorted(BASE)]), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "n_words", places.alias("places"), base.alias("base"), "kept")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce(F.col("kept.labels"), F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("kept.score"), F.lit(0.0)), F.when(F.size("places") > 0, F.lit(0.9)).otherwise(F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB SQL, with containment as an anti-join instead of a sweep."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ",\n".join(f"({quoted(r.label)}, {quoted(r.pattern)}, ' {r.keyword}#', {r.priority}, {r.weight}::DOUBLE)" for r in RULES)
    starts = lambda p: "list_transform(regexp_extract_all(numbered, '" + f" {p.split()[0]}#([0-9]+) " + "".join(f" {w}#[0-9]+ " for w in p.split()[1:]) + "', 1), lambda x: x::BIGINT)"
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SQL_WORD}') AS w FROM documents),
numbered AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(array_to_string(list_transform(w, lambda x, i: ' ' || x || '#' || (i - 1) || ' '), ''), '') AS numbered FROM words),
rules(label, pattern, keyword, priority, weight) AS (VALUES {rules}),
hits AS (
  SELECT doc_id, label, priority, weight, unnest(regexp_extract_all(numbered, pattern)) AS hit
  FROM numbered JOIN rules ON contains(numbered, keyword)),
found AS (
  SELECT doc_id, label, priority, weight, regexp_extract(hit, '#([0-9]+)', 1)::BIGINT AS lo, regexp_extract(hit, '^.*#([0-9]+)', 1)::BIGINT AS hi FROM hits),
kept AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(weight) AS score FROM found d
  WHERE NOT EXISTS (SELECT 1 FROM found e WHERE e.doc_id = d.doc_id AND e.priority <= d.priority AND e.lo <= d.lo AND e.hi >= d.hi
                    AND (e.lo, -e.hi, e.priority, e.label, e.weight) < (d.lo, -d.hi, d.priority, d.label, d.weight))
  GROUP BY doc_id),
base AS (
  SELECT doc_id, n_words, {', '.join(f'{starts(p)} AS "{label}"' for label, p in BASE.items())} FROM numbered),
placed AS (
  SELECT *, list_concat("mit", list_concat("apache-2", "cc-by-nc")) AS places,
    list_filter([{', '.join(f"CASE WHEN len({chr(34)}{label}{chr(34)}) > 0 THEN '{label}' END" for label in sorted(BASE))}], lambda x: x IS NOT NULL) AS base FROM base)
SELECT p.doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(k.labels, [])))), ','), '') AS labels,
  greatest(coalesce(k.score, 0), CASE WHEN len(places) > 0 THEN 0.9 ELSE 0 END)::DOUBLE AS score
FROM placed p LEFT JOIN kept k ON k.doc_id = p.doc_id"""
