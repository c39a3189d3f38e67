"""Subject areas of each document.

Labelling functions vote on every document and area, and a latent model that
learns how far to trust each vote turns them into a probability:

* lexicon: in how many of the court's own sentences of one numbered paragraph a
  word or pair of words of the area occurs (0, 1, 2, 3 or more), and in how many
  more a weaker hint does (0, 1, 2 or more);
* section: whether the headnote names the area, or hints at it;
* address: whether the parties' names, in the lines that address them, do;
* source: whether the area is more frequent than elsewhere in the document's source;
* label: whether the document is labelled with the area, or without it, or not at all.

The words come from labelled documents: a first lexicon from whole documents, then
a second one from the paragraphs that the first one settles; words of sentences
that name an area foreign to their paragraph tell sentences that only compare.
The model is a two-class mixture with one table of vote probabilities for each
function, labels among them, fitted by expectation-maximisation to the counts of
vote patterns over all documents; labelled and unlabelled documents weigh alike as
two bodies, so that labels anchor the classes and all documents shape the tables.
There are few patterns, however many documents.

At scale: one pass over the texts in Arrow batches that gives small votes, one
combining count of vote patterns, no shuffle of text.  The lexicon is fitted on at
most ``MOST_LABELLED`` labelled documents, taken in the order of a hash of their
ids; all else covers every document and every label.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, spread
from .tokens import small_batches

#: Labelled documents that the lexicon is fitted on at most.
MOST_LABELLED = 4000
#: Distinct sentences whose areas a task keeps.
CACHE = 200_000

_GARBLED = re.compile("[ÂÃ].|â..", re.S)
_PAGE = re.compile(r"\b(?:Page|Seite) \d+ \w+ \d+\b")
_HYPHEN = re.compile("[-\u00ad][ \t]*\n[ \t]*(?=[a-zß-ÿ])")
#: Headings that open the reasons, end them, and open the headnote.
_START = frozenset(("reasons", "entscheidungsgründe", "gründe", "motifs"))
_END = frozenset(("order", "tenor", "dispositif"))
_NOTE = frozenset(("headnote", "headnotes", "leitsatz", "leitsätze", "sommaire"))
_EDGE = " \t[](){}:.-–—*_#"
_MARK = re.compile(r"[ \t]*(?:\[(\d{1,4})\]|\((\d{1,4})\)|(\d{1,4})\.|(\d{1,4}))[ \t]+(?=\S)")
_QUOTE = re.compile('[“„”][^“”„]*[“”]|«[^»]*»|"[^"]*"')
_GERMAN_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
_SENTENCE = re.compile(rf"[.!?] (?=[^\W\d_a-zß-ÿ]|[\[(█«“„])(?!(?:{_GERMAN_MONTHS})\b)")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\W\d_]+")


def _ungarble(m: re.Match) -> str:
    for code in ("cp1252", "latin1"):
        try:
            return m.group().encode(code).decode("utf8")
        except UnicodeError:
            pass
    return m.group()


def read_ruling(text: str) -> tuple[str, str, list[list[str]]]:
    """``(address, headnote, paragraphs)``: what stands before the headnote or reasons, the headnote, and of each numbered
    paragraph of the reasons its sentences without quotations."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "Ã" in text or "Â" in text or "â" in text:
        text = _GARBLED.sub(_ungarble, text)
    lines = text.split("\n")
    if "Page " in text or "Seite " in text:
        lines = [x for x in lines if not (("Page " in x or "Seite " in x) and _PAGE.search(x))]
    start = note = end = None
    for i, x in enumerate(lines):
        if len(x) < 30:
            key = x.strip(_EDGE).lower()
            if key in _START:
                start = i if start is None else start
            elif key in _NOTE:
                note = i if note is None else note
            elif key in _END:
                end = i
            elif key.isdigit():
                lines[i] = ""  # a page number
    end = len(lines) if end is None or (start is not None and end < start) else end
    marks = []
    for i in range(0 if start is None else start + 1, end):
        if (x := lines[i].lstrip()) and (x[0] in "[(" or x[0].isdigit()) and (m := _MARK.match(lines[i])):
            marks.append((i, m.lastindex, int(m.group(m.lastindex)), m.end()))
    ones = [k for k, m in enumerate(marks) if m[2] == 1]
    # Without a heading the reasons are what the numbers, when they begin anew for the last time, lead to.
    cuts: list[tuple[int, int]] = []
    if ones:
        first = ones[0] if start is not None else ones[-1]
        for i, kind, n, at in marks[first:]:
            if kind == marks[first][1] and n == len(cuts) + 1:
                cuts.append((i, at))
    body = start if start is not None else cuts[0][0] if cuts else end
    noted = note is not None and note < body
    address = "\n".join(lines[: note if noted else body])
    headnote = "\n".join(lines[note + 1 : body]) if noted else ""
    paragraphs = []
    for k, (i, at) in enumerate(cuts):
        p = "\n".join(lines[i : cuts[k + 1][0] if k + 1 < len(cuts) else end])[at:]
        if "-" in p or "\u00ad" in p:
            p = _HYPHEN.sub("", p)
        p = " ".join(p.split())
        if "«" in p or "“" in p or "„" in p or '"' in p or "”" in p:
            p = _QUOTE.sub(" ", p)
        at, sentences = 0, []
        for m in _SENTENCE.finditer(p):
            sentences.append(p[at : m.start() + 1])
            at = m.end()
        sentences.append(p[at:])
        paragraphs.append(sentences)
    return address, headnote, paragraphs


def features(sentence: str) -> set[str]:
    """Words and pairs of neighbouring words."""
    w = _WORD.findall(sentence.lower())
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}


class Lexicon:
    """The areas that a sentence names by its words, and those that it hints at; it names none if it only compares or mentions."""

    def __init__(self, words: dict[str, str], hints: dict[str, str] | None = None, passing: frozenset[str] = frozenset()):
        self.words, self.hints, self.passing = words, hints or {}, passing
        self._known: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {}

    def marks(self, sentence: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        s = _DIGITS.sub("0", sentence)
        found = self._known.get(s)
        if found is None:
            all_ = features(s)
            named = {a for f in all_ if (a := self.words.get(f)) is not None}
            hinted = {a for f in all_ if (a := self.hints.get(f)) is not None} - named
            if named and not self.passing.isdisjoint(all_):
                named, hinted = set(), named
            found = tuple(named), tuple(hinted)
            if len(self._known) >= CACHE:
                self._known.clear()
            self._known[s] = found
        return found

    def count(self, paragraph: list[str]) -> Counter:
        return Counter(a for s in paragraph for a in self.marks(s)[0])


def learn_lexicon(rulings: dict[int, list[list[str]]], labels: dict[int, set[str]]) -> Lexicon:
    """Words and pairs that tell an area, from labelled documents' paragraphs."""
    # What must recur at least grows with the sample, from twice to four times.
    least = min(4, 2 + len(rulings) // 100)
    rulings = {d: [[_DIGITS.sub("0", s) for s in p] for p in ps] for d, ps in rulings.items()}
    of = {s: tuple(features(s)) for s in {s for ps in rulings.values() for p in ps for s in p}}
    n: Counter = Counter()
    with_area: Counter = Counter()
    for d, ps in rulings.items():
        seen = {f for s in {s for p in ps for s in p} for f in of[s]}
        n.update(seen)
        for a in labels[d]:
            with_area.update([(f, a) for f in seen])
    words = {f: a for (f, a), k in with_area.items() if k >= least and k >= 0.6 * n[f]}
    weak, passing = {}, set()
    for share in (0.6, 0.75, None):  # from whole documents to paragraphs, twice; then what only hints or compares
        lexicon = Lexicon(words)
        times: Counter = Counter()
        within: Counter = Counter()
        own: Counter = Counter()
        for d, ps in rulings.items():
            for p in ps:
                times.update(p)
                top = lexicon.count(p).most_common(1)
                main = top[0][0] if top and top[0][1] >= 2 and top[0][0] in labels[d] else None
                if main:
                    within.update([(s, main) for s in p])
                if share is None:
                    own.update([(s, main in named) for s in p if (named := lexicon.marks(s)[0])])
        n, with_area, home = Counter(), Counter(), Counter()
        for s, k in times.items():
            for f in of[s]:
                n[f] += k
        for (s, a), k in within.items():
            for f in of[s]:
                with_area[f, a] += k
        for (s, at_home), k in own.items():
            for f in of[s]:
                home[f, at_home] += k
        if share is None:
            weak = {f: a for (f, a), k in with_area.items() if f not in words and k >= 2 and k >= 0.5 * (n[f] + 1)}
            passing = {f for (f, at_home), k in home.items() if not at_home and f not in words and k >= least and k >= 0.9 * (k + home[f, True] + 1)}
        else:
            words = {f: a for (f, a), k in with_area.items() if k >= share * (n[f] + 0.4) and k >= least}
    return Lexicon(words, weak, frozenset(passing))


#: How many values each function's vote has: lexicon, section, address, source, label.
VALUES = (12, 3, 3, 2, 3)
UNLABELLED = 2


def votes(address: str, headnote: str, paragraphs: list[list[str]], lexicon: Lexicon) -> dict[str, tuple[int, int, int]]:
    """``(lexicon, section, address)`` votes of each area that any of them sees; the lexicon's is 3 times the sentences that name it plus those that hint."""
    best: dict[str, int] = {}
    for p in paragraphs:
        named, hinted = Counter(), Counter()
        for s in p:
            x, y = lexicon.marks(s)
            if x:
                named.update(x)
            if y:
                hinted.update(y)
        for a in {*named, *hinted}:
            best[a] = max(best.get(a, 0), 3 * min(named[a], 3) + min(hinted[a], 2))
    note, name = lexicon.marks(headnote), lexicon.marks(address)
    grade = lambda a, m: 2 if a in m[0] else int(a in m[1])
    return {a: (best.get(a, 0), grade(a, note), grade(a, name)) for a in {*best, *note[0], *note[1], *name[0], *name[1]}}


def pack_votes(pattern: Iterable[int]) -> int:
    out, place = 0, 1
    for v, size in zip(pattern, VALUES, strict=False):
        out, place = out + v * place, place * size
    return out


def unpack_votes(code: int) -> tuple[int, ...]:
    out = []
    for size in VALUES:
        out.append(code % size)
        code //= size
    return tuple(out)


def fit_votes(patterns: Iterable[tuple[tuple[int, ...], float]], rounds: int = 500) -> dict[tuple[int, ...], float]:
    """Probability that the area is dealt with, for each pattern of votes, from the patterns' counts.

    A vote's probabilities with and without the area are learned for every
    function, the labels included, which may be wrong or missing like any other
    vote.  Labels and, where there is none, two naming sentences only say where
    the iteration starts.  Documents without labels weigh together at most as
    much as those with labels, else their number alone would decide what the two
    classes mean.
    """
    rows = [(p, float(n)) for p, n in patterns if n > 0]
    marked = sum(n for p, n in rows if p[-1] != UNLABELLED)
    others = sum(n for p, n in rows if p[-1] == UNLABELLED)
    scale = min(1.0, marked / others) if marked and others else 1.0
    rows = [(p, n if p[-1] != UNLABELLED else n * scale) for p, n in rows]
    start = {0: 0.02, 1: 0.1, 2: 0.8, 3: 0.9}
    post = {p: start[p[0] // 3] if p[-1] == UNLABELLED else (0.97 if p[0] >= 3 else 0.6) if p[-1] else (0.51 if p[0] >= 6 else 0.01) for p, _ in rows}
    for _ in range(rounds):
        tables: list[dict[int, list[float]]] = [defaultdict(lambda: [0.1, 0.1]) for _ in VALUES]
        weight = [0.1, 0.1]
        for p, n in rows:
            for y, q in ((0, 1 - post[p]), (1, post[p])):
                weight[y] += n * q
                for table, v in zip(tables, p, strict=True):
                    table[v][y] += n * q
        new = {}
        for p, _ in rows:
            like = list(weight)
            for table, v in zip(tables, p, strict=True):
                for y in (0, 1):
                    like[y] *= table[v][y] / weight[y]
            new[p] = like[1] / (like[0] + like[1])
        moved = max((abs(new[p] - post[p]) for p in new), default=0.0)
        post = new
        if moved < 1e-6:
            break
    return post


def subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, most_labelled: int = MOST_LABELLED, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, subject_code, probability)`` of the areas that each document deals with, none, one or several.

    ``docs`` has ``doc_id, text`` and, for its vote, ``source``; ``labels`` has
    ``doc_id, subject_code``, in any case and with blanks, those of no known
    area being left out; ``areas`` has ``subject_code``.  A null or empty text
    deals with nothing; nor does any text if there are no labels.  A document
    given twice comes out once.  Whole texts are read, whatever their length.
    """
    spark = docs.sparkSession
    small_batches(spark)
    s = Scratch(spark, "subjects")
    codes = sorted(r[0] for r in areas.filter("subject_code is not null").select(F.lower(F.trim("subject_code"))).distinct().collect())
    known = labels.select("doc_id", F.lower(F.trim("subject_code")).alias("a")).filter(F.col("a").isin(codes) & F.col("doc_id").isNotNull())
    marked = known.groupBy("doc_id").agg(F.collect_set("a").alias("areas")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    texts = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = ["\n".join("\t".join(p) for p in read_ruling(t or "")[2]) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("areas"), pa.array(own, pa.string())], names=["doc_id", "areas", "own"])

    rulings: dict[int, list[list[str]]] = {}
    labelled: dict[int, set[str]] = {}
    for r in texts.mapInArrow(read, "doc_id long, areas array<string>, own string").collect():
        rulings[r[0]] = [p.split("\t") for p in r[2].split("\n")] if r[2] else []
        labelled[r[0]] = set(r[1])
    if not labelled or not codes:
        return spark.createDataFrame([], "doc_id long, subject_code string, probability double")
    learned = learn_lexicon(rulings, labelled)
    words, hints, passing = learned.words, learned.hints, learned.passing
    at = {a: i for i, a in enumerate(codes)}

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(words, hints, passing)
        for b in batches:
            ids, source, area, pattern = [], [], [], []
            for d, x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if t:
                    for a, v in votes(*read_ruling(t), lexicon).items():
                        ids.append(d)
                        source.append(x)
                        area.append(at[a])
                        pattern.append(pack_votes(v))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(source, pa.string()), pa.array(area, pa.int32()), pa.array(pattern, pa.int32())], names=["doc_id", "source", "area", "pattern"])

    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    given = docs.filter("doc_id is not null").select("doc_id", source.alias("source"), "text")
    seen = s.table(spread(given).mapInArrow(vote, "doc_id long, source string, area int, pattern int"))
    # Pairs of labelled documents, all areas of each: the label's vote.
    index = F.create_map(*(F.lit(x) for kv in at.items() for x in kv))
    own = known.select("doc_id", F.element_at(index, F.col("a")).alias("area"), F.lit(1).alias("label")).distinct()
    every = F.explode(F.sequence(F.lit(0), F.lit(len(codes) - 1)))
    asked = given.select("doc_id", "source").join(own.select("doc_id").distinct(), "doc_id").withColumn("area", every)
    asked = asked.join(own, ["doc_id", "area"], "left").select("doc_id", "area", F.col("source").alias("source_"), F.coalesce("label", F.lit(0)).alias("label"))
    pairs = seen.join(asked, ["doc_id", "area"], "full").select("doc_id", "area", F.coalesce("source", "source_").alias("source"), F.coalesce("pattern", F.lit(0)).alias("pattern"), F.coalesce("label", F.lit(UNLABELLED)).alias("label"))
    pairs = s.table(pairs)
    # The source's vote: the area is more frequent in it than overall, by the lexicon's votes.
    by_source = pairs.groupBy("source", "area").agg(F.sum((F.col("pattern") % VALUES[0] >= 6).cast("int")).alias("k"), F.count(F.lit(1)).alias("c"))
    sums = by_source.selectExpr("source as src", "area as ar", "k", "c", "sum(k) over (partition by source) as n", "sum(k) over (partition by area) as m", "sum(k) over () as every")  # one row a source and area
    more = sums.select("src", "ar", "c", (F.col("k") * F.col("every") > F.col("n") * F.col("m")).cast("int").alias("more"))
    same = F.col("source").eqNullSafe(F.col("src")) & (F.col("area") == F.col("ar"))
    place = pack_votes((0, 0, 0, 1)), pack_votes((0, 0, 0, 0, 1))
    both = pairs.join(more, same, "left").select("doc_id", "area", (F.col("pattern") + F.coalesce("more", F.lit(0)) * place[0] + F.col("label") * place[1]).alias("pattern"))
    counts = Counter({unpack_votes(r[0]): r[1] for r in both.groupBy("pattern").count().collect()})
    # Pairs of documents without labels that no function sees have but the source's vote.
    n_docs = given.groupBy("source").agg(F.count(F.lit(1)).alias("docs")).withColumn("area", every)
    rest = n_docs.join(more, same, "left").groupBy(F.coalesce("more", F.lit(0)).alias("more")).agg(F.sum(F.col("docs") - F.coalesce("c", F.lit(0))).alias("left"))
    for r in rest.collect():
        counts[0, 0, 0, r[0], UNLABELLED] += max(0, r[1])
    table = [(pack_votes(v), p) for v, p in fit_votes(counts.items()).items()]
    decided = both.join(F.broadcast(spark.createDataFrame(table, "pattern int, probability double")), "pattern").filter(F.col("probability") > threshold)  # at most as many rows as there are patterns
    code = F.element_at(F.array(*map(F.lit, codes)), F.col("area") + 1)
    return decided.groupBy("doc_id", "area").agg(F.max("probability").alias("probability")).select("doc_id", code.alias("subject_code"), "probability")
