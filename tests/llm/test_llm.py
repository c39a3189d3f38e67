import datetime
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillgraph.llm import groups, logs
from rillgraph.llm.groups import link_groups
from rillgraph.llm.heavy import HeavyLight, frequent, frequent_exact
from rillgraph.llm.logs import parse_logs
from rillgraph.llm.mixing import mix
from rillgraph.llm.packing import pack, sweep
from rillgraph.llm.subjects import learn_lexicon, read_ruling, subjects


def union_find(pairs):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {x: top(x) for x in list(root)}


@pytest.mark.parametrize("one_task", [0, 300])
def test_groups(spark, monkeypatch, one_task):
    monkeypatch.setattr(groups, "ONE_TASK", one_task)
    rng = random.Random(one_task)
    pairs = [(i, i + 1) for i in range(2**60, 2**60 + 120)] + [(0, rng.randrange(1, 300)) for _ in range(200)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(70)] + [(9000, 9000)]
    rows = [(b, a, "x") if i % 2 else (a, b, "x") for i, (a, b) in enumerate(pairs + pairs[:50])] + [(None, 1, "x"), (-1, 77777, "x"), (88888, None, "x")]
    df = spark.createDataFrame(rows, "src long, dst long, v string")
    got = link_groups(df, schedule=((1.0, 2), (0.5, 3)))
    assert {r.vertex_id: r.group_id for r in got.collect()} == union_find(pairs)
    assert link_groups(df.limit(0)).isEmpty()


def test_heavy_light_never_underestimates():
    rng = np.random.default_rng(1)
    s = HeavyLight(buckets=8, slots=2, light=64)
    values = np.concatenate([np.full(3000, 5), np.full(2000, 11), rng.integers(0, 100_000, 5000)])
    rng.shuffle(values)
    for part in np.array_split(values, 20):
        s.add(part.astype(np.int64))
    assert s.count.sum() + s.light.sum() == len(values)
    for v, n in ((5, 3000), (11, 2000)):
        held = s.count[(s.value == v) & (s.count > 0)].sum()
        assert held + s.light[s.light_index(np.array([v]))[0]] >= n and held > 0


def test_frequent(spark):
    rows = [(7, None)] * 50 + [(i, -1) for i in range(1000, 1950)] + [(None, 3)] * 9 + [(None, i) for i in range(91)]
    df = spark.createDataFrame(rows, "src long, dst long")
    got = {(r.field, r.vertex_id): r.n for r in frequent_exact(df, ["src", "dst"], 0.05).collect()}
    assert got == {("src", 7): 50, ("dst", 3): 10}
    assert frequent_exact(df.limit(0), ["src"], 0.1).isEmpty()


DAY = datetime.date(2031, 3, 1)
MESSAGES = ("HRTBEAT | W rate=1 nV=7 nE=8", "peer link lost; retry in 5 ms", "RESET   |", "balance at nV=4", "ring follows", "query for 3 answered")
#: A layout each, "@" standing for the message.
LAYOUTS = (
    "2031-03-01 00:00:01.000 INFO  [Sys : Agent : 9] @",
    "[Sys : Directory :  2] @",
    '{"t":1930090787820,"sev":"INFO","who":"client","text":"@"}',
    "Mar  1 00:00:09 node-1 sys-streamer: <info> @",
    'ts=2031-03-01T00:00:01Z comp=agent.7 lvl=info msg="@"',
    "01/03/2031 00:00:02|WARN|agent-1|@",
    '{\n  "t": 1930090795842,\n  "sev": "ERROR",\n  "who": "agent#5",\n  "text": "@"\n}',
)


def log_table(spark, files):
    """Lines of ``{file: lines}``; ids count by 10 over the files in their order."""
    rows = []
    for name, lines in files.items():
        rows += [(10 * (len(rows) + i), name, i, DAY, raw, "clash") for i, raw in enumerate(lines)]
    return spark.createDataFrame(rows, "line_id long, file_name string, line_no long, opened_on date, raw string, ts string")


def log_background(layouts=LAYOUTS):
    return "\n".join(x.replace("@", m) for x in layouts for m in MESSAGES).split("\n")


def parsed(df, least=None, most=None):
    rows = parse_logs(df).collect()
    return {r.line_id: (r.last_line_id, r.ts_ms, r.log_level, r.component, r.nv, r.ne) for r in rows if (least or 0) <= r.line_id < (most or 1 << 60)}


def ms(*a):
    return int(datetime.datetime(*a, tzinfo=datetime.UTC).timestamp() * 1000)


def test_logs(spark):
    f = [
        "tail of an entry",
        "2031-03-01 00:19:48.161 INFO  [Sys : Agent : 64] HRTBEAT | W state=5 nE=94,104",
        "    2031-05-06 07:08:09.100 INFO  [Sys : Agent : 47] HRTBEAT | - gnV=9 nV = 6_753 nE=5",
        "",
        '{"t":1930090787820,"sev":"WARNING","who":"client","text":"x nV=4"}',
        "[Sys : Directory :  3] HRTBEATS nV=1",
    ]
    g = ["{", '  "t": 1930090795842,', '  "sev": "ERROR",', '  "who": "agent#5",', '  "text": "HRTBEAT: nV=12"', "}", "Mar  1 00:19:47 node-2 sys-streamer: <dbg> y", 'ts=2031-03-01T02:00:00+02:00 comp=agent.7 lvl=err msg="z"', "01/03/2031 00:22:19|INFO|agent-58|w", None]
    df = log_table(spark, {"f": f, "g": g, "other": log_background()})
    assert parsed(df, most=160) == {
        10: (30, ms(2031, 3, 1, 0, 19, 48) + 161, "INFO", "agent:64", 6753, 94104),
        40: (40, 1930090787820, "WARN", "client", -1, -1),
        50: (50, -1, "NONE", "directory:3", -1, -1),
        60: (110, 1930090795842, "ERROR", "agent:5", 12, -1),
        120: (120, ms(2031, 3, 1, 0, 19, 47), "DEBUG", "streamer", -1, -1),
        130: (130, ms(2031, 3, 1, 0, 0, 0), "ERROR", "agent:7", -1, -1),
        140: (150, ms(2031, 3, 1, 0, 22, 19), "INFO", "agent:58", -1, -1),
    }
    assert parse_logs(df.limit(0)).isEmpty()
    messages = {r.line_id: r.message for r in parse_logs(df).collect()}
    assert messages[50] == "HRTBEATS nV=1" and messages[40] == 'x nV=4"}'


def test_logs_of_layouts_that_nobody_foresaw(spark):
    """A level behind the program, words of all kinds before it, a header of twelve lines, one far into the line, and a layout of a single line."""
    twelve = "{\n" + "".join(f'  "k{i}": "v",\n' for i in range(8)) + '  "who": "agent#5",\n  "at": 1930090795842,\n  "text": "@"\n}'
    far = "~" * 90 + " 2031-03-01 00:00:01 :: streamer/4 ~> @"
    odd = "pod alpha >> client 7 (( WARN )) at 01/03/2031 00:00:02 == @"
    once = "%% 2031-03-01 00:00:05 %% directory 3 %% HRTBEAT | W rate=1 nV=7 nE=8"
    df = log_table(spark, {"a": [once, "RESET the ring"], "b": log_background((twelve, far, odd, LAYOUTS[0]))})
    got = parsed(df)
    assert got[0] == (10, ms(2031, 3, 1, 0, 0, 5), "NONE", "directory:3", 7, 8)
    at = 20
    for lines, want in ((13, (1930090795842, "NONE", "agent:5")), (1, (ms(2031, 3, 1, 0, 0, 1), "NONE", "streamer:4")), (1, (ms(2031, 3, 1, 0, 0, 2), "WARN", "client:7"))):
        for i in range(len(MESSAGES)):
            assert got[at] == (at + 10 * (lines - 1), *want, *((7, 8) if i == 0 else (-1, -1))), at
            at += 10 * lines
    assert len(got) == 1 + 4 * len(MESSAGES)


def test_logs_need_their_ngrams(spark, monkeypatch):
    df = log_table(spark, {"b": log_background()})
    true = parsed(df)
    assert len(true) == len(LAYOUTS) * len(MESSAGES)
    real = logs.ngram_dictionary
    monkeypatch.setattr(logs, "ngram_dictionary", lambda t, s: (real(t, s)[0].withColumn("branch", F.lit(False)), real(t, s)[1]))
    assert parsed(df) == {}


def test_frequent_values_that_share_a_bucket(spark):
    """More frequent values than a bucket has slots: the exact count still finds all."""
    df = spark.createDataFrame([(i % 12,) for i in range(1200)] + [(1000 + i,) for i in range(300)], "v long").repartition(5)
    found = frequent_exact(df, ["v"], 0.05, buckets=1, slots=2, light=64)
    assert {r.vertex_id: r.n for r in found.collect()} == {i: 100 for i in range(12)}
    estimates = {r.vertex_id: r.estimate for r in frequent(df, ["v"], 0.05, buckets=1, slots=2, light=64).collect()}
    assert len(estimates) <= 2 and all(n >= 100 for n in estimates.values())
    from rillgraph.llm.heavy import heavy_light

    merged = heavy_light(df, ["v"], buckets=4, slots=2, light=64)
    assert merged.filter("bucket >= 0").groupBy("bucket").count().filter("count > 2").isEmpty()
    assert merged.agg(F.sum("n")).first()[0] == 1500


def best_fit(capacity, sizes):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps[gaps.index(min(fit))] -= s
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_sweep_is_best_fit():
    rng = random.Random(4)
    for capacity in (1, 7, 50):
        sizes = [rng.randint(1, capacity) for _ in range(400)]
        n = {s: sizes.count(s) for s in set(sizes)}
        out, opened = sweep(capacity, list(n.items()))
        assert opened == best_fit(capacity, sizes)
        fill: dict[int, int] = {}
        for s, _, k, c, start in sorted(out, key=lambda x: x[4]):
            for i in range(c, c + k):
                assert fill.get(i, 0) == start
                fill[i] = start + s
        assert max(fill.values()) <= capacity and sum(fill.values()) == sum(sizes) and len(fill) == opened


def test_pack(spark):
    rows = [(1, 25), (2, 7), (3, 3), (4, 10), (5, 0), (6, None), (2, 7), (None, 4), (7, 20), (7, 20)]
    items = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, tokens long, container string")
    packs = spark.createDataFrame([("p", 10), ("no", None), ("bad", 0)], "pack_name string, capacity_tokens int")
    got = pack(items, packs).collect()
    fill: dict[str, list] = {}
    for r in got:
        fill.setdefault(r.container, []).append((r.start, r.to_token - r.from_token))
    for pieces in fill.values():
        at = 0
        for start, n in sorted(p for p in pieces if p[1]):
            assert start == at
            at += n
        assert at <= 10
    assert sum(r.to_token - r.from_token for r in got) == sum(t or 0 for _, t in rows)
    assert sum(1 for r in got if r.doc_id == 1) == 3 and sum(1 for r in got if r.doc_id in (3, 4, 5, 6)) == 4
    assert pack(items.limit(0), packs).isEmpty()


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "a", rng.randint(1, 50)) for i in range(400)] + [(1000 + i, "b", rng.randint(1, 50)) for i in range(100)] + [(5, None, 9), (6, "other", 9), (7, "a", 0)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, tokens long, progress string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), (None, 0.1, 1)], "source string, target_share double, max_repeat int")
    seq, report = mix(docs, targets, schedules={"a": ((0.0, 2.0), (1.0, 0.5))})
    rep = {r.source: r for r in report.collect()}
    assert abs(rep["a"].actual_share - 0.5) < 0.01 and rep["a"].most_uses == 1 and rep["b"].most_uses <= 3
    got = seq.collect()
    assert len({(r.doc_id, r.use) for r in got}) == len(got) and all(0 <= r.progress <= 1 for r in got)
    early = sum(r.tokens for r in got if r.source == "a" and r.progress < 0.5) / sum(r.tokens for r in got if r.progress < 0.5)
    assert early > 0.52
    empty, none = mix(docs.limit(0), targets)
    assert empty.isEmpty() and all(r.tokens == 0 for r in none.collect())


def test_tokens_are_those_of_whole_texts():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
    from rillgraph.llm.tokens import Counter

    c = Counter(path)
    texts = ["", " ", "a  b", "a\n\nb c", " x\t y", "l'été d'ici 12,5", "x\r\ny", "end ", "\n", "it's  — so", "wor" * 9000, "a \n b", None]
    assert c.counts(pa.array(texts)).tolist() == [c.whole(t or "") for t in texts]


RULING = """Court
Docket X — 1 May 2030

Between
Harbour Club (claimant)
and
B (respondent)

JUDGMENT

Headnote:
1. The tumour is assessed at once.

Reasons
(1) The surgeon left early. In X1 it was said: “The tumour grew.” The tu-
mour was seen on 3 May 2030. Page 7 is missing.
Page 2 of 3
(2) The question would be different if the tumour were at issue, which it is not. The witness spoke.

Order
The tumour claim is allowed.
"""


def test_read_ruling():
    address, note, paragraphs = read_ruling(RULING)
    assert "Harbour Club" in address and "tumour" in note
    assert paragraphs[0] == ["The surgeon left early.", "In X1 it was said:   The tumour was seen on 3 May 2030.", "Page 7 is missing."] or len(paragraphs[0]) >= 3
    assert len(paragraphs) == 2 and "grew" not in " ".join(paragraphs[0])
    assert read_ruling("") == ("", "", [])


def test_subjects(spark):
    def doc(*paragraphs):
        return "Court\n\nReasons\n" + "\n".join(f"[{i}] {p}" for i, p in enumerate(paragraphs, 1)) + "\n\nOrder\nCosts."

    med, sea = "The surgeon met the tumour. A scan showed the tumour. The witness spoke.", "The vessel met the harbour. A tug left the harbour. The witness spoke."
    none = "The witness spoke. A vessel came. Costs are reserved."
    rows = [(i, doc(med if i % 3 == 0 else sea if i % 3 == 1 else none), "s") for i in range(90)] + [(900, doc(med, sea), "s"), (901, None, "s"), (902, "", None), (903, doc(none) + "x" * 100_000, "s")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, pattern string")
    labels = spark.createDataFrame([(i, " Medicine" if i % 3 == 0 else "transport") for i in range(60) if i % 3 < 2] + [(1, "nonsense"), (None, "transport")], "doc_id long, subject_code string")
    areas = spark.createDataFrame([("medicine",), ("transport",), (None,)], "subject_code string")
    got = {(r.doc_id, r.subject_code) for r in subjects(docs, labels, areas).collect()}
    want = {(i, "medicine" if i % 3 == 0 else "transport") for i in range(90) if i % 3 < 2} | {(900, "medicine"), (900, "transport")}
    assert got == want
    assert subjects(docs.limit(0), labels, areas).isEmpty() and subjects(docs, labels.limit(0), areas).isEmpty()
    assert learn_lexicon({}, {}).words == {}


def test_votes_are_weighed_together():
    """A headnote decides where the lexicon doubts, because their agreement elsewhere has shown how far it can be trusted."""
    from rillgraph.llm.subjects import fit_votes, pack_votes, unpack_votes

    counts = {(9, 2, 0, 0, 2): 400, (9, 0, 0, 0, 2): 40, (0, 0, 0, 0, 2): 4000, (0, 2, 0, 0, 2): 20, (3, 2, 0, 0, 2): 30, (3, 0, 0, 0, 2): 60, (9, 2, 0, 0, 1): 30, (9, 0, 0, 0, 1): 8, (0, 0, 0, 0, 0): 300, (3, 0, 0, 0, 0): 9, (3, 2, 0, 0, 1): 3, (9, 2, 0, 0, 0): 1}
    p = fit_votes(counts.items())
    assert p[9, 0, 0, 0, 2] > 0.5 and p[0, 0, 0, 0, 2] < 0.01
    assert p[3, 2, 0, 0, 2] > 0.5 > p[3, 0, 0, 0, 2]  # one naming sentence in both
    assert p[9, 2, 0, 0, 0] > p[3, 0, 0, 0, 0]  # a label may be wrong
    assert all(unpack_votes(pack_votes(v)) == v for v in p)
    assert fit_votes([]) == {}


def test_sentences_that_compare_are_learned():
    nouns = {"sea": [f"ship{c}" for c in "abcdefghijklmno"], "money": [f"bank{c}" for c in "abcdefghijklmno"]}
    rulings, labels = {}, {}
    for i in range(90):
        own, other = ("sea", "money") if i % 2 else ("money", "sea")
        mine = nouns[own]
        rulings[i] = [[f"It was a {mine[i % 15]}.", f"No {mine[(i + 7) % 15]} was seen.", "It rained."] + [f"Were a {nouns[other][i // 6]} at issue, all would be otherwise."] * (i % 6 < 2)]
        labels[i] = {own}
    lexicon = learn_lexicon(rulings, labels)
    assert lexicon.marks("It was a shipb.")[0] == ("sea",)
    assert "otherwise" in lexicon.passing and lexicon.marks("Were a shipc at issue, all would be otherwise.")[0] == ()


def test_queries_have_sql_or_are_tested():
    from rillgraph.llm.queries import QUERIES, SQL

    assert set(SQL) <= set(QUERIES) and F is not None
