"""Text functions as column expressions: lines, line endings, templates, commands and headers."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a line, the pair first.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """What ``then`` makes of a value that is computed once, however often it is named, and wherever the plan puts the whole."""
    return F.element_at(F.transform(F.array(value), then), 1)


def lines(text: Column | str) -> Column:
    """The lines of a text without their ends; no empty one after a last end; none for an empty or null text."""
    whole = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return let(F.split(F.coalesce(_col(text), F.lit("")), LINE_END, -1), whole)


def line_ending(text: Column | str) -> Column:
    """CR LF if there are more of these than of bare LF, else LF."""
    text = _col(text)
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    return F.when(count("\\r\\n") > count("(?<!\\r)\\n"), "\r\n").otherwise("\n")


def with_endings(text: Column | str, ending: Column | str) -> Column:
    """All line ends made one kind."""
    plain = F.replace(_col(text), F.lit("\r\n"), F.lit("\n"))
    return F.replace(plain, F.lit("\n"), F.lit(ending) if isinstance(ending, str) else ending)


def template_fields(template: str) -> list[str]:
    """Names in braces, in order, each once; doubled braces are no fields; anything but a bare name is an error."""
    found = re.findall(r"\{([^{}]*)\}", template.replace("{{", "").replace("}}", ""))
    bad = [x for x in found if not x.isidentifier()]
    if bad:
        raise ValueError(f"not a plain field: {bad[0]!r}")
    return list(dict.fromkeys(found))


def fields_of(template: Column | str) -> Column:
    """As ``template_fields``, of a column of templates: the bare names in braces, in order, each once."""
    plain = F.replace(F.replace(_col(template), F.lit("{{"), F.lit("")), F.lit("}}"), F.lit(""))
    return F.array_distinct(F.regexp_extract_all(plain, F.lit("\\{([A-Za-z_]\\w*)\\}"), F.lit(1)))


def unknown_fields(templates: DataFrame, columns: DataFrame) -> DataFrame:
    """template_id and field of the fields of templates (template_id, template) that no column (name) has."""
    asked = templates.select("template_id", F.explode(fields_of("template")).alias("field"))
    return asked.join(columns.select(F.col("name").alias("field")), "field", "left_anti")


def rendered(template: str, columns: Sequence[str], header: str | None = None) -> Column:
    """The template with each field's column in its place, null as nothing; unknown fields are an error."""
    fields = template_fields(template)
    unknown = [f for f in fields if f not in columns]
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    parts = re.split(r"(\{\{|\}\}|\{[^{}]*\})", template)
    out = [F.lit({"{{": "{", "}}": "}"}.get(p, p)) if not re.fullmatch(r"\{[^{}]+\}", p) else F.coalesce(F.col(p[1:-1]).cast("string"), F.lit("")) for p in parts if p]
    body = F.concat(*out) if out else F.lit("")
    return F.concat(F.lit(f"**{header}**\n"), body) if header else body


def challenge(header: Column | str) -> Column:
    """The k="v" pairs of a header as a map, the last of a name counting."""
    header = F.coalesce(_col(header), F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(header, F.lit('(\\w+)="([^"]*)"'), F.lit(1)).alias("k"), F.regexp_extract_all(header, F.lit('(\\w+)="([^"]*)"'), F.lit(2)).alias("v"))
    lasts = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + F.lit(2), F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(lasts)


def tokens(command: Column | str) -> Column:
    """Words of a command line: parts in single or double quotes stay together, without the quotes."""
    found = F.regexp_extract_all(F.coalesce(_col(command), F.lit("")), F.lit("(?:\"[^\"]*\"|'[^']*'|[^\\s\"'])+"), F.lit(0))
    return F.transform(found, lambda t: F.regexp_replace(t, "\"([^\"]*)\"|'([^']*)'", "$1$2"))


def arguments(command: Column | str, names: Sequence[str]) -> Column:
    """A struct of named arguments: name=value where that is said, else the words in their order; null if not given."""
    words = F.slice(tokens(command), 2, 1_000_000)
    starting = lambda mark: F.filter(words, lambda w: F.startswith(w, F.lit(mark)))
    given = [F.try_element_at(starting(f"{n}="), F.lit(-1)) for n in names]
    plain = F.filter(words, lambda w: ~F.regexp_like(w, F.lit(f"^(?:{'|'.join(map(re.escape, names))})=")))
    place, out = 0, []
    for n, g in zip(names, given):
        out.append(F.coalesce(F.substring(g, len(n) + 2, 1_000_000), F.try_element_at(plain, F.lit(place + 1))).alias(n))
        place += 1
    return F.struct(*out)


def arity_error(command: Column | str, names: Sequence[str], required: int) -> Column:
    """What is wrong with the number of arguments, or null."""
    words = F.size(tokens(command)) - 1
    return F.when(words < required, "too few arguments").when(words > len(names), "too many arguments")


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob: braces are alternatives, ** is any depth and only stands alone, case does not count."""
    return "(?i)^(?:" + "|".join(_one(_spaced(p)) for p in expanded(pattern)) + ")$"


def expanded(pattern: str) -> list[str]:
    """One pattern per choice of the brace groups, in order."""
    m = re.search(r"\{([^{}]+)\}", pattern)
    if not m:
        return [pattern]
    return [x for alt in m[1].split(",") for x in expanded(pattern[: m.start()] + alt.strip() + pattern[m.end() :])]


def expanded_rows(patterns: DataFrame) -> DataFrame:
    """pattern_id and pattern: for each pattern (pattern_id, pattern) one row for each choice of its brace groups.

    Each round opens the first group of every pattern that has one.
    """
    group = "\\{([^{}]+)\\}"
    rows, done = patterns.select("pattern_id", "pattern"), None
    while True:
        closed = rows.filter(~F.col("pattern").rlike(group))
        done = closed if done is None else done.unionByName(closed)
        rows = rows.filter(F.col("pattern").rlike(group))
        if rows.isEmpty():
            return done
        alternatives = F.split(F.regexp_extract("pattern", group, 1), ",")
        head, tail = F.regexp_extract("pattern", f"^(.*?){group}", 1), F.regexp_extract("pattern", f"^.*?{group}(.*)$", 2)
        rows = rows.select("pattern_id", head.alias("head"), tail.alias("tail"), F.explode(alternatives).alias("one"))
        rows = rows.select("pattern_id", F.concat("head", F.trim("one"), "tail").alias("pattern"))


def glob_expression(pattern: Column | str) -> Column:
    """As ``glob_regex``, of a column of patterns without braces; case counts as there."""
    quoted = F.regexp_replace(_col(pattern), "([.+^$|()\\[\\]{}\\\\])", "\\\\$1")
    for sign, to in (("(^|/)\\*\\*/", "$1\u0001"), ("\\*\\*", "\u0002"), ("\\*", "[^/]*"), ("\\?", "[^/]"), ("\u0001", "(?:[^/]+/)*"), ("\u0002", ".*")):
        quoted = F.regexp_replace(quoted, sign, to)
    return F.concat(F.lit("(?i)^(?:"), quoted, F.lit(")$"))


def as_utc(text: Column | str) -> Column:
    """A time as text, with an offset or without one, which then counts as UTC: a timestamp."""
    text = _col(text)
    aware = text.rlike("(?i)(z|[+-]\\d\\d:?\\d\\d)$")
    return F.to_timestamp(F.when(aware, text).otherwise(F.concat(text, F.lit("Z"))))


def _spaced(pattern: str) -> str:
    """``**`` made a part of its own: the rest of its part follows as the next one."""
    out: list[str] = []
    for part in pattern.split("/"):
        rest = part.replace("**", "*")
        out += [part] if part == "**" or "**" not in part else ["**", *([rest] if rest != "*" else [])]
    return "/".join(out)


def _one(pattern: str) -> str:
    out = ""
    for i, part in enumerate(parts := pattern.split("/")):
        last = i == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
            continue
        piece = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in part)
        out += piece + ("" if last else "/")
    return out
