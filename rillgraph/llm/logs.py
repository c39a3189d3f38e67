"""Semi-structured log lines into entries with time, level, component and message.

No layout is written down here.  Digits, level words, month names and program
names are masked as classes, and dictionaries of the masked lines' token bigrams
and trigrams, counted over all lines, tell constant tokens from variable ones: a
token is constant where its trigram (word, what stands between, word) holds
``CONSTANT`` of the bigram that it continues, else variable.  A bigram that
many different trigrams continue, none of them mostly, is a *branch*.  What leads
from a line's first column through a program name to the next branch is the
header of a layout, since the messages behind a header differ and the header does
not.  Words that follow branches behind two or more bigrams open messages; they
end the header of a layout that is too rare to branch itself, if it holds a time
or a level.  So a layout may be as rare as one line, and lines alone, without any
that resemble them, teach none.  Only then do the headers' fields get roles by
type (time, level, program, number), and headers are compiled to one pattern.

At scale: only distinct masked lines enter the n-gram counts, weighted by their
number, since masking leaves few.  What stays in order (a bracket that opens a
header of several lines, what a block of ``BLOCK`` lines hands to the next) goes
through blocks of files; entries are put together by sums that combine on the map
side.  So neither a huge file nor a huge entry is ever in one task.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Scratch, spread

BLOCK = 20_000
#: A header that a bracket opens has at most so many lines, by definition.
HEADER_LINES = 1000
#: A constant token holds this share of the bigram before it; a branch has this many continuations of a hundredth each, the first below nine tenths.
CONSTANT, CONTINUATION, FIRST, MANY = 0.05, 0.01, 0.9, 4
PROGRAMS = ("agent", "directory", "client", "streamer")
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
#: Spellings of each level, in lower case.
LEVELS = {"DEBUG": ("debug", "dbg", "d"), "INFO": ("information", "info", "inf", "i"), "WARN": ("warning", "warn", "wrn", "w"), "ERROR": ("error", "err", "e")}

LVL, PROG, MON, D10, D13, VAR = (chr(0xE000 + i) for i in range(6))
NUM = r"\d+(?:[,_]\d+)*"
_WORDS = "|".join(sorted((w for ws in LEVELS.values() for w in ws if len(w) > 1), key=len, reverse=True))
_MONTH = "|".join(MONTHS[i : i + 3] for i in range(0, 36, 3))
#: Word classes: mask and pattern.
CLASSES = ((LVL, rf"(?i:\b(?:{_WORDS})\b)|\b[DIWE]\b"), (PROG, rf"(?i:\b(?:{'|'.join(PROGRAMS)})\b)"), (MON, rf"\b(?:{_MONTH})\b"))
#: Times: the form that one takes in a masked line, and the pattern of its values.
TIMES = {
    "iso": (r"0-0-0[T ]0:0:0(?:\.0)?(?:Z|[+-]0:?0)?", r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?"),
    "dmy": (r"0/0/0 0:0:0", r"\d\d/\d\d/\d{4} \d\d:\d\d:\d\d"),
    "mon": (rf"{MON} 0 0:0:0", rf"(?:{_MONTH}) +\d{{1,2}} \d\d:\d\d:\d\d"),
    "sec": (rf"{D10}\.0", r"\d{10}\.\d{3}"),
    "ms": (D13, r"\d{13}"),
}
_SHAPES = "|".join(f"(?P<{k}>{shape})" for k, (shape, _) in TIMES.items())
_TYPED = re.sub(r"\?P<\w+>", "?:", _SHAPES) + f"|{LVL}"
_WORD = r"[\p{L}_]+|[\x{E000}-\x{E002}]"
BEAT, SEP, HIT = "HRTBEAT", "\x01", "\x02"


def digits_masked(line: Column) -> Column:
    """The line with each number as 0 (those of 10 and of 13 digits apart) and runs of blanks as one."""
    out = F.regexp_replace(line, r"(?<![\d,_])\d{13}(?![\d_])", D13)
    out = F.regexp_replace(out, r"(?<![\d,_])\d{10}(?![\d_])", D10)
    return F.regexp_replace(F.regexp_replace(out, NUM, "0"), r"\s+", " ")


def classed(line: Column) -> Column:
    return reduce(lambda c, t: F.regexp_replace(c, t[1], t[0]), CLASSES, line)


def _opened(lines: DataFrame) -> DataFrame:
    """``(line_id, ..., text)`` of the lines that only open a bracket: with those that follow, to where one closes it."""
    w = Window.partitionBy("file_name", "block").orderBy("line_no", "line_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    part = lines.filter(F.col("opens") | F.col("raw").rlike(r"^(?:\s|$|[\]})])"))
    copies = F.when((F.col("line_no") % BLOCK < HEADER_LINES) & (F.col("block") > 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both = part.withColumn("copy", F.explode(copies)).withColumn("block", F.col("block") - F.col("copy")).dropDuplicates(["file_name", "block", "line_id"])
    both = both.withColumn("row", F.row_number().over(w)).withColumn("closed", F.sum(F.col("raw").rlike(r"^\s*[\]})]").cast("int")).over(upto))
    both = both.withColumn("by", F.max(F.when(F.col("opens"), F.struct("row", "line_no", F.col("line_id").alias("id"), "closed", "copy"))).over(upto))
    # One follows the other without a gap, and nothing is closed before.
    near = (F.col("row") - F.col("by.row") == F.col("line_no") - F.col("by.line_no")) & (F.col("row") - F.col("by.row") < HEADER_LINES)
    inside = both.filter(near & (F.col("by.copy") == 0) & (F.col("closed") - F.col("by.closed") - F.col("raw").rlike(r"^\s*[\]})]").cast("int") == 0))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]), "\n")
    return inside.groupBy(F.col("by.id").alias("line_id")).agg(F.first("file_name").alias("file_name"), F.min("block").alias("block"), F.max("opened_on").alias("opened_on"), text.alias("text")).withColumn("raw", F.substring_index("text", "\n", 1))


def ngram_dictionary(texts: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(grams, lines)`` of the lines in ``text``.

    ``lines (id, n, at)`` are the distinct masked lines with their number and
    their trigrams in order, ``grams (w1, g, w2, c3, c2, constant, branch)`` the
    dictionary: the counts of each trigram and of the bigram that it continues.
    """
    masked = texts.groupBy(digits_masked(F.col("text")).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    masked = masked.groupBy(classed(F.col("d")).alias("m")).agg(F.sum("n").alias("n"))
    cut = masked.select(F.xxhash64("m").alias("id"), "n", F.regexp_extract_all("m", F.lit(_WORD), F.lit(0)).alias("words"), F.split("m", _WORD, -1).alias("gaps"))
    # A class stands for many words, so that it says little: with what stands before it, it makes one token.
    word = f"if(words[i - 1] rlike '[{LVL}-{MON}]', concat(if(i = 1, '^', words[i - 2]), gaps[i - 1], words[i - 1]), words[i - 1])"
    at = f"transform(gaps, (g, i) -> struct(i as i, if(i = 0, '^', {word}) as w1, g as g, if(i < size(words), words[i], '$') as w2))"
    lines = s.table(cut.select("id", "n", F.expr(at).alias("at")))
    three = lines.select("n", F.explode("at").alias("x")).groupBy("x.w1", "x.g", "x.w2").agg(F.sum("n").alias("c3"))
    two = three.groupBy("w1", "g").agg(F.sum("c3").alias("c2"), F.max("c3").alias("top"))
    three = three.join(two, ["w1", "g"])
    many = three.groupBy("w1", "g").agg(F.count(F.when(F.col("c3") >= F.col("c2") * CONTINUATION, 1)).alias("many"))
    constant = (F.col("c3") >= F.col("c2") * CONSTANT) | F.col("w2").rlike(f"[{LVL}-{MON}]")
    branch = (F.col("top") < F.col("c2") * FIRST) & (F.col("many") >= MANY)
    return s.table(three.join(many, ["w1", "g"]).select("w1", "g", "w2", "c3", "c2", constant.alias("constant"), branch.alias("branch"))), lines


def headers(grams: DataFrame, lines: DataFrame, s: Scratch) -> DataFrame:
    """``(head, n)``: the masked headers with variable tokens masked too, and the lines that have each."""
    named = lines.filter(F.exists("at", lambda x: x["w2"] == PROG)).select("id", "n", F.explode("at").alias("x")).select("id", "n", "x.*")
    known = s.table(named.join(grams.select("w1", "g", "w2", "c3", "c2", "constant", "branch"), ["w1", "g", "w2"]))
    behind = F.min(F.when(F.col("w1").endswith(PROG), F.col("i"))).over(Window.partitionBy("id"))
    after = known.withColumn("program", behind).filter("i >= program")
    # The first branch behind the program; the words that follow such branches behind several bigrams.
    first = after.filter("branch").groupBy("id").agg(F.min_by(F.struct("w1", "g", "w2", "c3", "c2"), "i").alias("x")).select("x.*")
    openers = first.filter((F.col("c3") >= F.col("c2") * CONTINUATION) & ~F.col("w2").isin("$", LVL)).select("w1", "g", "w2").distinct()
    openers = openers.groupBy("w2").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("w2", F.lit(True).alias("opener"))
    ends = after.join(openers, "w2", "left").groupBy("id").agg(F.min(F.when(F.col("branch"), F.col("i"))).alias("branch_at"), F.min(F.when(F.col("opener"), F.col("i"))).alias("opener_at"))
    whole = known.groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "g", "w2", "constant"))).alias("a")).join(ends, "id")
    upto = lambda end: F.array_join(F.transform(F.slice("a", 1, F.col(end) + 1), lambda x: F.concat(x["g"], F.when(x["i"] == F.col(end), "").when(x["constant"], x["w2"]).otherwise(VAR))), "")
    by_branch, by_opener = (F.when(F.col(c).isNotNull(), upto(c)) for c in ("branch_at", "opener_at"))
    sooner = (F.col("branch_at").isNull() | (F.col("opener_at") < F.col("branch_at"))) & by_opener.rlike(_TYPED)
    head = F.when(sooner, by_opener).otherwise(by_branch)
    return whole.select(head.alias("head"), "n").filter("head is not null").groupBy("head").agg(F.sum("n").alias("n"))


def learn_layouts(texts: DataFrame) -> list[str]:
    """The layouts' headers, masked, the most frequent first; ``texts`` has one column ``text``, the lines that may begin an entry.

    The list holds what n-grams leave distinct, not lines: it grows with the number of layouts.
    """
    s = Scratch(texts.sparkSession, "layouts")
    found = [r[0] for r in headers(*ngram_dictionary(texts, s), s).orderBy(F.desc("n"), "head").collect()]
    s.close()
    # What only goes on where a more frequent header ends is that header and the beginning of a message.
    return [h for i, h in enumerate(found) if not any(h.startswith(x) for x in found[:i])]


ROLES = (*TIMES, "level", "program", "number")


def _alternative(head: str, n: int) -> tuple[str, dict[str, int]]:
    """A header as a pattern whose groups begin with the ``n``-th, and the group of each role: the first of each type, and the number next to the program."""
    out, groups = [], {}
    tokens = list(re.finditer(rf"{_SHAPES}|(?P<level>{LVL})|(?P<program>{PROG})|(?P<number>0)|(?P<blank> )|(?P<other>.)", head, re.S))
    values = {LVL: CLASSES[0][1], PROG: CLASSES[1][1], MON: rf"(?:{_MONTH})", D10: r"\d{10}", D13: r"\d{13}", VAR: r"[\p{L}_]+"}
    beside = False
    for t in tokens:
        kind, text = t.lastgroup, t.group()
        value = TIMES[kind][1] if kind in TIMES else NUM if kind == "number" else values.get(text)
        role = kind if kind in ROLES else None
        if kind in TIMES and any(k in groups for k in TIMES) or role in groups or kind == "number" and not beside:
            role = None
        if role:
            groups[role] = n + len(groups)
            out.append(f"({value})")
        elif value:
            out.append(f"(?:{value})")
        else:
            out.append(r"\s+" if kind == "blank" else re.sub(r"([^\w])", r"\\\1", text))
        beside = kind == "program" or beside and not (value or text.isalpha())
    text = "".join(out)
    return text[:-3] + r"\s*" if text.endswith(r"\s+") else text, groups


def compiled(layouts: list[str]) -> tuple[str, str]:
    """One pattern of all headers, and the replacement that makes of a line that has one the fields in the order of ``ROLES``, whether its message begins with the heartbeat's word, and the message."""
    alternatives, of, n = [], {r: [] for r in ROLES}, 1
    for head in sorted(layouts, key=len, reverse=True):
        text, groups = _alternative(head, n)
        if text in alternatives:  # the same fields, spelled differently
            continue
        alternatives.append(text)
        n += len(groups)
        for role, g in groups.items():
            of[role].append(f"${g}")
    fields = SEP.join("".join(of[r]) for r in ROLES)
    return rf"(?s)^(?:{'|'.join(alternatives)})({BEAT}\b)?(.*)$", f"{HIT}{fields}{SEP}${n}{SEP}${n}${n + 1}"


def _millis(kind: str, t: Column) -> Column:
    iso = lambda c: F.unix_millis(c.try_cast("timestamp"))
    part = lambda p: F.regexp_extract(t, p, 1)
    if kind == "iso":
        x = F.replace(F.replace(t, F.lit(" "), F.lit("T")), F.lit(","), F.lit("."))
        return iso(F.when(x.rlike(r"(?:Z|[+-]\d\d:?\d\d)$"), F.regexp_replace(x, r"([+-]\d\d)(\d\d)$", "$1:$2")).otherwise(F.concat(x, F.lit("Z"))))
    if kind == "dmy":
        return iso(F.concat(F.regexp_replace(t, r"^(\d\d)/(\d\d)/(\d{4}) ", "$3-$2-$1T"), F.lit("Z")))
    if kind == "mon":
        month = F.format_string("%02d", ((F.instr(F.lit(MONTHS), F.substring(t, 1, 3)) + 2) / 3).cast("int"))
        return iso(F.concat(F.year("opened_on").cast("string"), F.lit("-"), month, F.lit("-"), F.lpad(part(r" (\d{1,2}) "), 2, "0"), F.lit("T"), part(r"(\d\d:\d\d:\d\d)"), F.lit("Z")))
    return F.replace(t, F.lit("."), F.lit("")).try_cast("bigint")


def _level(t: Column) -> Column:
    low = F.lower(t)
    return reduce(lambda c, kv: c.when(low.isin(*kv[1]), kv[0]), LEVELS.items(), F.when(F.lit(False), F.lit("")))


def _count_of(name: str, line: Column) -> Column:
    x = F.regexp_extract(line, rf"(?<![A-Za-z0-9_]){name}\s*=\s*([0-9]+(?:[,_][0-9]{{3}})*)(?![0-9])", 1)
    return F.when(line.contains(name), F.regexp_replace(F.nullif(x, F.lit("")), "[,_]", "").try_cast("bigint"))


def _rows(lines: DataFrame) -> DataFrame:
    rows = spread(lines).select(F.col("line_id").cast("long").alias("line_id"), F.coalesce("file_name", F.lit("")).alias("file_name"), F.coalesce(F.col("line_no").cast("long"), F.lit(-1)).alias("line_no"), "opened_on", F.coalesce("raw", F.lit("")).alias("raw"))
    opens = F.col("raw").rlike(r"^[\[{(]\s*$") & (F.col("line_no") >= 0)
    return rows.filter("line_id is not null").withColumn("block", F.floor(F.greatest("line_no", F.lit(0)) / BLOCK)).withColumn("opens", opens)


def parse_logs(lines: DataFrame, layouts: list[str] | None = None, with_message: bool = True) -> DataFrame:
    """``(line_id, last_line_id, file_name, ts_ms, log_level, component, message, nv, ne)``, one row for each entry.

    ``lines`` has ``line_id, file_name, line_no, opened_on, raw``; other
    columns are not read.  An entry starts at a line that begins, in its first
    column, with the header of a layout; the lines that follow in the file, up
    to the next header, belong to it, and lines before a file's first header
    belong to none.  ``layouts`` are those of an earlier :func:`learn_layouts`;
    without them they are learned from the lines themselves, and a line whose
    header nothing else resembles begins no entry.  ``ts_ms`` is -1 without a
    time (or one that is no date, or lacks the year because ``opened_on`` is
    null), ``log_level`` NONE without a level, ``nv`` and ``ne`` -1 unless the
    message begins with the word for a heartbeat and gives them, the first
    mention counting.  ``message`` is the rest of the header's line, null unless
    ``with_message``.  A null line counts as an empty one, a null file name as
    one file; a line with a null ``line_no`` opens no header of several lines.
    Of an empty table the result is empty.  Repeated lines with one ``line_id``
    are one line.
    """
    s = Scratch(lines.sparkSession, "logs")
    rows = _rows(lines)
    opened = s.table(_opened(rows))
    whole = rows.filter("not opens").select("line_id", "file_name", "block", "opened_on", F.col("raw").alias("text"), "raw").unionByName(opened.select("line_id", "file_name", "block", "opened_on", "text", "raw"))
    if layouts is None:
        layouts = learn_layouts(whole.filter(~F.col("text").rlike(r"^\s|^$")).select("text"))
    text = F.col("text")
    if layouts:
        pattern, fields = compiled(layouts)
        read = F.when(~F.substring("raw", 1, 1).isin(" ", "\t", ""), F.regexp_replace(text, pattern, fields))
        parts = F.when(read.startswith(HIT), F.split(F.substring(read, 2, 1 << 30), SEP, len(ROLES) + 2))
    else:
        parts = F.lit(None).cast("array<string>")
    # The parts are made once: a generator stands between them and the fields that name them.
    rows = whole.select("line_id", "file_name", "block", "opened_on", _count_of("nV", F.col("raw")).alias("nv"), _count_of("nE", F.col("raw")).alias("ne"), F.explode(F.array(parts)).alias("f"))
    field = {r: F.nullif(F.get("f", F.lit(i)), F.lit("")) for i, r in enumerate((*ROLES, "beat", "message"))}
    ts = F.coalesce(*(F.when(field[k].isNotNull(), _millis(k, field[k])) for k in TIMES))
    component = F.concat_ws(":", F.lower(field["program"]), F.regexp_replace(field["number"], "[,_]", "").try_cast("bigint").cast("string"))
    message = F.get("f", F.lit(len(ROLES) + 1)) if with_message else F.lit(None).cast("string")
    small = rows.select(
        "file_name",
        "block",
        "line_id",
        F.when(F.col("f").isNotNull(), F.col("line_id")).alias("head"),
        ts.alias("ts"),
        _level(field["level"]).alias("level"),
        F.when(F.col("f").isNotNull(), component).alias("component"),
        field["beat"].isNotNull().alias("beat"),
        message.alias("message"),
        "nv",
        "ne",
    )
    small = s.table(small)
    # What a block takes over from those before it: the last header above.
    blocks = small.groupBy("file_name", "block").agg(F.max("head").alias("last"))
    above = F.max("last").over(Window.partitionBy("file_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("above", above).select("file_name", "block", "above")
    w = Window.partitionBy("file_name", "block").orderBy("line_id").rowsBetween(Window.unboundedPreceding, 0)
    owned = small.withColumn("own", F.max("head").over(w)).join(blocks, ["file_name", "block"])
    owned = owned.withColumn("entry", F.coalesce("own", "above")).filter("entry is not null")
    is_head = F.col("head").isNotNull()
    entries = owned.groupBy("entry").agg(
        F.max("line_id").alias("last_line_id"),
        F.min("file_name").alias("file_name"),
        *(F.max(F.when(is_head, F.col(c))).alias(c) for c in ("ts", "level", "component", "beat", "message")),
        F.min(F.when(F.col("nv").isNotNull(), F.struct("line_id", "nv"))).alias("nv"),
        F.min(F.when(F.col("ne").isNotNull(), F.struct("line_id", "ne"))).alias("ne"),
    )
    given = lambda c: F.when(F.col("beat"), F.coalesce(c, F.lit(-1))).otherwise(F.lit(-1)).cast("long")
    return entries.select(
        F.col("entry").alias("line_id"),
        "last_line_id",
        "file_name",
        F.coalesce("ts", F.lit(-1)).cast("long").alias("ts_ms"),
        F.coalesce("level", F.lit("NONE")).alias("log_level"),
        "component",
        "message",
        given(F.col("nv.nv")).alias("nv"),
        given(F.col("ne.ne")).alias("ne"),
    )
