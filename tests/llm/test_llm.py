"""Training-data operators against brute force on small tables, with nulls, ties, repeats and empty input."""

import itertools
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattloom.llm import answers, mixing, overlap, packing, spans, splits
from wattloom.llm.components import components, related
from wattloom.llm.tables import split_name, state_key
from wattloom.llm.tokens import RANKS, token_counts


def groups_of(rows):
    """Row id -> smallest row id of its group, for rows (id, key, key)."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, *keys in rows:
        for n, k in enumerate(keys):
            if k is not None:
                parent[find(("r", i))] = find((n, k))
    members = defaultdict(list)
    for i, *_ in rows:
        members[find(("r", i))].append(i)
    return {i: min(m) for m in members.values() for i in m}


def test_ids_and_splits(spark):
    ids = ["Case9_S0042-he07", " case09 s42 HE7 ", "case9_s42_he70", "--", None]
    a, b, c, d, e = [r[0] for r in spark.createDataFrame([(x,) for x in ids], "x string").select(state_key(F.col("x"))).collect()]
    assert a == b == "case|9|s|42|he|7" and c != a and d is None and e is None
    assert [r[0] for r in spark.createDataFrame([(" dev\n",), ("TRAIN",), ("  ",), (None,)], "x string").select(split_name(F.col("x"))).collect()] == ["DEV", "TRAIN", None, None]


@pytest.mark.parametrize("seed", range(3))
def test_related(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["hot"] * 4 + [None] * 3 + [f"s{rnd.randrange(40)}" for _ in range(9)]), rnd.choice([None, f"e{rnd.randrange(150)}"]), "clash") for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, s string, e string, root string")
    assert dict(map(tuple, related(df, "id", ["s", "e"]).collect())) == groups_of([r[:3] for r in rows])


def test_long_chain(spark):
    e = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {tuple(r) for r in components(e).collect()} == {(i, 0) for i in range(1, 301)}


ROWS = "id bigint, s string, e string, split string, label string"


def test_leaks_and_new_splits(spark):
    rnd = random.Random(7)
    rows = [(i, f"s{min(rnd.randrange(300), rnd.randrange(300))}", f"e{rnd.randrange(2500)}", rnd.choice(["TRAIN"] * 8 + ["DEV", None]), rnd.choice("aaaab")) for i in range(3000)]
    df = spark.createDataFrame(rows, ROWS)
    root = groups_of([r[:3] for r in rows])
    kinds = defaultdict(set)
    for i, _, _, s, _ in rows:
        kinds[root[i]] |= {s} - {None}
    want = {(root[r[0]], r[0]) for r in rows if len(kinds[root[r[0]]]) > 1}
    assert {tuple(r) for r in splits.leaks(df, "id", ["s", "e"], "split").collect()} == want
    for shard in (100_000, 500):
        loose = [(i, f"s{i // 3}", None, None, rnd.choice("aaaaabn")) for i in range(3000)]
        got = splits.assign_splits(spark.createDataFrame(loose, ROWS), "id", ["s", "e"], ["label"], shard_rows=shard).collect()
        assert len(got) == 3000 and len({(r.component, r.new_split) for r in got}) == 1000
        label = {r[0]: r[4] for r in loose}
        n = Counter((label[r.row_id], r.new_split) for r in got)
        for k in "abn":
            total = sum(n[k, s] for s in splits.NAMES)
            for s, share in zip(splits.NAMES, splits.SHARES):
                assert abs(n[k, s] / total - share) < 0.03, (shard, k, s)


def test_rare_labels_reach_every_split(spark):
    """50 records of a rare label over 50 shards, and a label with a record or two in each of many shards."""
    rows = [(i, f"s{i}", None, "abcdef"[i * 7 % 6], "rare" if i % 100 == 0 else "few" if i % 10 == 1 else "x") for i in range(5000)]
    got = splits.assign_splits(spark.createDataFrame(rows, ROWS), "id", ["s", "e"], ["label", "split"], shard_rows=100).collect()
    label = {r[0]: r[4] for r in rows}
    n = Counter((label[r.row_id], r.new_split) for r in got)
    assert [n["rare", s] for s in splits.NAMES] == [40, 5, 5]
    for k, total in (("few", 500), ("x", 4450)):
        assert all(abs(n[k, s] / total - share) < 0.03 for s, share in zip(splits.NAMES, splits.SHARES)), n
    many = spark.createDataFrame([(i, None, None, None, f"v{i}") for i in range(300)], ROWS)
    with pytest.raises(ValueError):
        splits.assign_splits(many, "id", ["s", "e"], ["label"])


def test_splits_edges(spark):
    empty = spark.createDataFrame([], ROWS)
    assert splits.assign_splits(empty, "id", ["s", "e"], ["label"]).count() == 0 and splits.leaks(empty, "id", ["s", "e"], "split").count() == 0
    one = [(i, "hot", None, "TRAIN", None) for i in range(60)] + [(100 + i, None, None, None, "x") for i in range(40)]
    got = splits.assign_splits(spark.createDataFrame(one, ROWS), "id", ["s", "e"], ["label"]).collect()
    assert len({r.new_split for r in got if r.row_id < 60}) == 1 and len(got) == 100


RECORD = '{"e":[0],"b":[0.5,0.5,0,0,0,0],"g":[0,0,0,0],"cf":[0,0],"i":0,"a":1,"p":[0,0,0],"q":0.5}'
PROMPT = "Zone Sedby reports 6526.8 MW, forecast peak 2720.0 MW at 22:04. The last cleared price was 54.95 USD/MWh. Return the decision record for case LN-95346."
ANSWER = "The card points to action 2. Load at Dunham is 2887.0 MW, and I do not expect the limit of 7018.7 MW to bind before 15:41."


@pytest.mark.parametrize(
    "answer,defect",
    [
        (None, "empty"), (" \n\t", "empty"), ("```json\n```", "empty"), ("[]", "empty"), ("N/A", "empty"), ("<|im_end|>", "empty"), ('""', "empty"), ("​", "empty"), ('{"answer": ""}', "empty"),
        (RECORD, None), (f"```json\n{RECORD}\n```", None), (f"{RECORD}<|im_end|>", None), (f"{ANSWER}\n{RECORD}", None), (ANSWER, None),
        (RECORD[:40], "truncated"), (RECORD[:-1], "truncated"), (f"{ANSWER}\n{RECORD[:30]}", "truncated"), (ANSWER[:60], "truncated"), ("Take action 2: the spread of 119.72 USD/MWh", "truncated"),
        (PROMPT, "copied"), (PROMPT.upper(), "copied"), (f"Question: {PROMPT}", "copied"), (f"> {PROMPT} Thank you.", "copied"), (json.dumps({"answer": PROMPT}), "copied"), ("The last cleared price was 54.95 USD/MWh.", "copied"),
        (f'You state: "The last cleared price was 54.95 USD/MWh." {ANSWER}', None),
        ("I'm sorry, but I can't help with that request.", "refusal"), ('{"error": "This is something I cannot answer."}', "refusal"), ("Es tut mir leid, dabei kann ich nicht helfen.", "refusal"), ("抱歉，我无法回答这个问题。", "refusal"), ("No puedo decidir un precio.", "refusal"),
        (f"I cannot see a reason to wait. {ANSWER}", None), (f"I'm sorry the card is so short, but {ANSWER}", None), ("There is no need to decline the hour. " + ANSWER, None),
        ("Die Karte spricht für Aktion 2. Die Last in Dunham beträgt 2887.0 MW und ein Engpass vor 15:41 Uhr ist nicht zu erwarten.", "language"), ("建议选择动作 4：价差 180.96 美元仍有空间，出力保持在 4741.1 兆瓦附近。", "language"),
    ],
)
def test_defects(answer, defect):
    assert answers.judge(answer, PROMPT, None) == defect


@pytest.mark.parametrize(
    "sentence,lead,close",
    [
        ("Give a reason.", "Here is what you asked: ", ""), ("Return the decision record now.", "You asked me the following: ", " That is the question."),
        ("Bitte begründen Sie die Wahl.", "Sie haben mich Folgendes gefragt: ", " Das ist die Frage."), ("Explique el motivo.", "Usted me preguntó lo siguiente: ", " Esa es la pregunta."), ("请说明理由。", "", ""), ("请说明理由。", "您的问题是：", "谢谢。"),
    ],
)
def test_one_short_sentence_is_a_copy(sentence, lead, close):
    assert answers.judge(lead + sentence + close, f"{PROMPT} {sentence}", None) == "copied"


@pytest.mark.parametrize("answer", ["Hold steady and keep output unchanged today.", "Keep the markup where it is. The spread is narrow.", "Lieber abwarten, bis die Last sinkt.", "Zone Sedby is quiet. Wait for the next hour."])
def test_proper_answers_without_digits(answer):
    assert answers.judge(answer, PROMPT, None) == ("language" if answer.startswith("Lieber") else None)


def test_compression_decides_copies():
    """Sentences of the prompt in another order are copies; parts of an own answer, however much of the prompt it takes up, are none."""
    a, b, c = answers.sentences(PROMPT)
    assert answers.judge(f"{c} {a} {b}", PROMPT, None) == "copied" and answers.judge(f"Sure: {b.upper()}", PROMPT, None) == "copied"
    assert answers.judge(f"{a} {b} So take action 3.", PROMPT, None) is None
    assert answers.judge(f"{a} {b} The reserve margin looks thin, imports are falling fast, and waiting until evening would hardly cost anything at all.", PROMPT, None) is None


def test_terminal_words(spark):
    """A full stop after an abbreviation doesn't end the sentence; only the other answers tell."""
    tails = ["Take action 2, reserve is approx. half of it. Fine. Go on.", "Take action 1, so approx. nothing is lost. Fine."] * 3
    rows = [(i, PROMPT, t) for i, t in enumerate(tails)] + [(10, PROMPT, "Take action 1, since reserve is approx."), (11, PROMPT, "Take action 1, since all is fine.")]
    df = spark.createDataFrame(rows, "id bigint, prompt string, text string")
    assert [tuple(r) for r in answers.defects(df, "id", "prompt", "text").collect()] == [(10, "truncated")]
    assert answers.judge(rows[-2][2], PROMPT, None) is None
    low = [(i, PROMPT, "load at fenham rises at harbury. state the action. wait at harbury. and so on.") for i in range(20, 30)] + [(40, PROMPT, "Take action 1, since all is fine in Harbury."), (41, PROMPT, "take action 1, since all is fine in harbury.")]
    assert answers.defects(spark.createDataFrame(low, "id bigint, prompt string, text string"), "id", "prompt", "text").count() == 0  # texts without capitals tell nothing
    record = [(i, PROMPT, f"Take action 1, since all is fine in Harbury.\n{RECORD}") for i in range(20, 30)] + [(40, PROMPT, "Take action 1, since all is fine in Harbury.")]
    assert answers.defects(spark.createDataFrame(record, "id bigint, prompt string, text string"), "id", "prompt", "text").count() == 0  # keys of a record go on with no sentence
    few = df.where("id IN (0, 10, 11)")  # one observation is drawn to the prior
    assert answers.defects(few, "id", "prompt", "text").count() == 0


def test_terminal_contexts(spark):
    tails = ["hold action 2, since Fenham keeps 81.5 MW and more. Take action 4. Look again at 09:15. Fine it is."] * 4
    rows = [(i, PROMPT, t) for i, t in enumerate(tails)] + [(10, PROMPT, "Take action 1, since Dunham keeps 81."), (11, PROMPT, "Wait for it. Take action 4."), (12, None, None), (13, None, ANSWER), (10, PROMPT, "Take action 1, since Dunham keeps 81.")]
    df = spark.createDataFrame(rows, "id bigint, prompt string, text string")
    assert sorted(map(tuple, answers.defects(df, "id", "prompt", "text").collect())) == [(10, "truncated"), (10, "truncated"), (12, "empty")]
    assert answers.defects(df.where("false"), "id", "prompt", "text").count() == 0
    assert answers.judge("word " * 200_000, PROMPT, None) == "truncated"


def brute_pairs(rows, span):
    seen = defaultdict(set)
    for i, t in rows:
        for p in range(len(t or "") - span + 1):
            seen[t[p : p + span]].add(i)
    cover = {}
    for i, t in rows:
        m = np.zeros(len(t or ""), bool)
        for p in range(len(m) - span + 1):
            if len(seen[t[p : p + span]]) > 1:
                m[p : p + span] = True
        cover[i] = int(m.sum())
    return {p for v in seen.values() for p in itertools.combinations(sorted(v), 2)}, cover


def check_spans(df, text, form, size, want, cover):
    if form == "pairs":
        assert {tuple(r) for r in spans.shared_pairs(df, span=60, group_rows=size).collect()} == want
    elif form == "coverage":
        assert {r.doc_id: r.shared_chars for r in spans.shared_coverage(df, span=60, group_rows=size).collect()} == cover
    else:
        found, masks = defaultdict(set), {i: np.zeros(len(t or ""), bool) for i, t in text.items()}
        for r in spans.shared_spans(df, span=60, group_rows=size).collect():
            assert r.n_chars >= 60 and r.start >= 0
            found[r.span_id].add((r.doc_id, text[r.doc_id][r.start : r.start + r.n_chars]))
            masks[r.doc_id][r.start : r.start + r.n_chars] = True
        assert all(len({t for _, t in v}) == 1 and len({i for i, _ in v}) > 1 for v in found.values())
        assert {i: int(m.sum()) for i, m in masks.items()} == cover


@pytest.mark.parametrize("seed", range(4))
def test_spans(spark, seed):
    rnd = random.Random(seed)
    alphabet = "ab" if seed == 0 else "abcdefgh é語𝄞"
    word = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    shared = [word(rnd.choice([30, 45, 60, 61, 90, 200])) for _ in range(8)]
    rows = [(i, word(rnd.randrange(0, 60)) + rnd.choice(shared)[rnd.randrange(0, 12) :] + word(rnd.randrange(0, 80)) + rnd.choice(["", rnd.choice(shared)])) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "a" * 300), (105, "a" * 100)]
    want, cover = brute_pairs(rows, 60)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, prefix string")
    small = (7, 30, 100, 2)[seed]  # suffixes of a prefix in one task: each form of the result is split further for some seed
    for form in ("pairs", "coverage", "spans"):
        for size in (200_000, small) if form == ("pairs", "coverage", "spans", "pairs")[seed] else (200_000,):
            check_spans(df, dict(rows), form, size, want, cover)
    assert spans.shared_spans(df.where("false")).count() == 0
    assert spans.shared_pairs(df.where("false")).count() == 0 and spans.shared_coverage(df.where("false")).count() == 0


def test_span_of_many_documents(spark):
    """A span's task gives a row per document, not per pair; the pairs come from blocks."""
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    footer, copy = word(70), word(150)
    rows = [(i, word(40) + footer + word(40)) for i in range(2000)]
    suffixes = [{"prefix": 1, "lo": 46, "hi": 61, "doc_id": i, "party": i, "pos": 50, "left": t[36:50], "right": t[50:110]} for i, t in rows]
    assert sum(len(f) for f in spans._tree(60, True, iter([pd.DataFrame(suffixes)]))) <= 10 * len(rows)
    rows = rows[:300] + [(1000 + i, copy) for i in range(100)] + [(2000, copy + footer)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for size in (200_000, 150):
        got = [tuple(r) for r in spans.shared_pairs(df, span=60, group_rows=size, block=20).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, 60)[0]
        assert len(got) == 300 * 299 // 2 + 100 * 99 // 2 + 400


def test_long_spans_are_whole(spark):
    """A span far longer than the context comes out as one row per document, and a part that a third document has as another."""
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    long = word(900)
    rows = [(1, word(70) + "<" + long + ">" + word(90)), (2, word(20) + "[" + long + "]"), (3, word(60) + "(" + long[300:520] + ")" + word(40))]
    got = {(r.doc_id, r.start, r.n_chars, r.span_id) for r in spans.shared_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    whole = {(i, a, n) for i, a, n, _ in got if n == 900}
    assert whole == {(1, 71, 900), (2, 21, 900)}
    assert {(3, 61, 220)} <= {(i, a, n) for i, a, n, _ in got}


def test_same_id_twice(spark):
    t = "".join(random.Random(1).choice("abcdef") for _ in range(250))
    df = spark.createDataFrame([(1, t), (1, t)], "doc_id bigint, text string")
    assert spans.shared_pairs(df).count() == 0


SFT = "id bigint, prompt string, target string, split string"


def record(rnd, jitter=0.0, drop=0, style=0):
    state = rnd
    lines = [f"  load {k} mw" for k in "abcdefghij"]
    vals = [state["v"][k] + jitter for k in range(10)]
    body = [f"{n}{' = ' if style else ': '}{v:,.2f}{' MW' if style else ''}" for n, v in zip(lines, vals)][: 10 - drop]
    body.append("  hourly load mw: [" + ",".join(f"{x + jitter:.2f}" for x in state["h"]) + "]")
    text = "\n".join(body[::-1] if style else body)
    return text.upper() if style else text


def test_overlap(spark):
    rnd = random.Random(3)
    rows, base = [], []
    for k in range(30):
        s = {"v": [rnd.uniform(100, 9000) for _ in range(10)], "h": [rnd.uniform(100, 9000) for _ in range(12)]}
        t = {"e": [k % 8], "b": [round(rnd.random(), 2) for _ in range(6)], "g": [0, 1, 2, 0], "cf": [0, 1], "i": 1, "a": k % 6, "p": [1, 2, 3], "q": 0.5}
        base.append((s, t))
        rows.append((k, record(s), json.dumps(t), "TRAIN"))
    spell = lambda t, q: json.dumps(dict(sorted((t | {"q": q}).items())), indent=1)
    for k in range(20):
        s, t = base[k]
        rows.append((100 + k, record(s, 0.05 if k % 2 else 0.0, style=k % 3 == 0), spell(t, 0.5 + (0.05 if k % 4 else 0.0)), "DEV"))
    s, t = base[25]
    rows += [(200, record(s, 0.2), json.dumps(t), "DEV"), (201, record(s), spell(t, 0.6), "DEV"), (202, record(s), json.dumps(t | {"a": 9}), "DEV"), (203, record(s, drop=4), json.dumps(t), "DEV"), (204, record(s, drop=5), json.dumps(t), "DEV")]
    rows += [(300, None, json.dumps(t), "DEV"), (301, record(s), None, "DEV"), (302, record(s), "{", "DEV"), (303, record(s), json.dumps(t), None), (304, rows[0][1], rows[0][2], "TRAIN")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SFT + ", side int")
    side = F.when(F.col("split") == "TRAIN", "T").when(F.col("split") == "DEV", "E")
    texts = overlap.texts(df, "id", "prompt", "target", side, [F.col("split")])
    got = {tuple(r) for r in overlap.pairs(texts).collect()}
    want = {(k, 100 + k) for k in range(20)} | {(304, 100), (25, 203)}
    assert got == want
    whole = F.concat_ws("\n", "prompt", "target")
    cov = {r.id: (r.covered_chars, r.n_chars) for r in overlap.coverage(df, "id", whole, side, []).collect()}
    assert cov[2][0] > 0 and cov[28][0] == 0 and all(a <= b for a, b in cov.values())
    assert overlap.pairs(texts.where("false")).count() == 0 and overlap.coverage(df.where("false"), "id", whole, side, []).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_runs_come_from_common_prefixes(spark, seed):
    """However the sorted suffixes are cut into parts, texts that agree with the other side past the target's line form the runs."""
    rnd = random.Random(seed)
    rows = [(i, rnd.choice("TTTE"), 0.5, [f"e={'0,' * 12}{min(rnd.randrange(25), rnd.randrange(25))};a={rnd.randrange(2)}", f"load={i}"]) for i in range(90)]
    rows += [(100 + i, "TE"[i == 7], 0.5, ["e=hot;b=0.1,0.2", f"load={i}"]) for i in range(40)]
    rows += [(200 + i, "TE"[i % 9 == 0], 0.5, [f"e={'7,' * 70}{rnd.randrange(12)}", f"load={i}"]) for i in range(40)]  # the line is longer than what sets the part
    o = overlap.Overlap(spark.createDataFrame(rows, "id bigint, side string, q double, lines array<string>"))
    sides = defaultdict(set)
    for _, s, _, x in rows:
        sides[x[0]].add(s)
    want = {i: x[0] for i, _, _, x in rows if len(sides[x[0]]) == 2}
    for chars in (10_000_000, 900, 60):
        assert {r.id: r.run.strip() for r in o.runs(chars).collect()} == want
    assert set(want) <= {r.id for r in o.array().collect()} < {r[0] for r in rows}


def test_pairs_come_from_the_array(spark, monkeypatch):
    """Without the array's runs pairs are lost; a target that very many records have meets in small buckets."""
    rows = [(i, "TE"[i % 5 == 0], 0.5, ["e=hot;b=0.1,0.2", "branches=2", "load=" + ",".join(f"{1000 * (i // 5 * 5 if i % 10 < 6 else i) + 7 * k + (0.05 if k == 0 and i % 5 == 0 else 0):.2f}" for k in range(12))]) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, side string, q double, lines array<string>")
    numbers = {i: [2.0, *map(float, x[2][5:].split(","))] for i, _, _, x in rows}
    want = {(a, b) for a, s, _, _ in rows for b, u, _, _ in rows if s == "T" and u == "E" and sum(abs(p - q) <= 0.06 for p, q in zip(numbers[a], numbers[b])) >= 0.8 * 13}
    for chars in (10_000_000, 2000):
        assert {(r.train_id, r.eval_id) for r in overlap.pairs(df, part_chars=chars).collect()} == want
    array = overlap.Overlap.array
    monkeypatch.setattr(overlap.Overlap, "array", lambda self, n: array(self, n).withColumn("run", F.col("id").cast("string")))
    assert want and overlap.pairs(df).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_coverage_against_brute_force(spark, seed):
    """Shared runs count wherever they start: inside a line, at a short line, or in a list with one differing number."""
    rnd = random.Random(seed)
    numbers = lambda n: [f"{rnd.uniform(100, 9999):.1f}" for _ in range(n)]
    lists = [numbers(24) for _ in range(4)]
    rows = [(900, "T", ["x" * 80]), (901, "E", ["x" * 50]), (902, "T", ["short"]), (903, "E", ["short"]), (904, "T", ["é語𝄞" * 20]), (905, "E", ["b" + "é語𝄞" * 20]), (906, "E", None)]
    for i in range(40):
        of = list(rnd.choice(lists))
        of[rnd.randrange(24)] = numbers(1)[0]
        rows.append((i, rnd.choice("TE"), [f"e={i};a={rnd.randrange(3)}", "hourly load mw=" + ",".join(of), *[f"zone {k} mw={v}" for k, v in zip("abc", numbers(3))]]))
    rows += [(i + 100, s, x) for i, s, x in rows[-6:]] + [(i + 200, "T", x) for i, _, x in rows[-6:]]
    text = {i: "\n".join(x or "") for i, _, x in rows}
    df = spark.createDataFrame([(i, s, text[i] if x else None, 7) for i, s, x in rows] + [(999, None, "x" * 80, 7)], "id bigint, side string, text string, sides int")
    for span in (48, 80):
        has = {s: {text[i][p : p + span] for i, t, _ in rows if t == s for p in range(len(text[i]) - span + 1)} for s in "TE"}
        want = {}
        for i, s, _ in rows:
            m = np.zeros(len(text[i]), bool)
            for p in range(len(m) - span + 1):
                if text[i][p : p + span] in has["TE".replace(s, "")]:
                    m[p : p + span] = True
            want[i] = (int(m.sum()), len(m))
        short = {i for i in want if want[i][1] < span}  # copies of a short text on both sides are whole copies
        for size in ((50_000, 3) if seed == 0 and span == 48 else (50_000,)):
            got = {r.id: (r.covered_chars, r.n_chars) for r in overlap.coverage(df, "id", F.col("text"), F.col("side"), [], span, size).collect()}
            assert {i: v for i, v in got.items() if i not in short} == {i: v for i, v in want.items() if i not in short} and set(got) == set(want)
    assert overlap.coverage(df.where("false"), "id", F.col("text"), F.col("side"), []).count() == 0


def test_tokens_and_packing(spark):
    assert token_counts(spark.createDataFrame([("hello world", 1), ("", 2), (None, 3), ("汉字 emoji 🎉", 4)], "t string, n_other int"), "t", [F.col("n_other")], RANKS).where("n_tokens > 0").count() == 2
    rnd = random.Random(5)
    items = [(i, int(rnd.expovariate(1 / 60))) for i in range(800)] + [(900, 1000), (901, 100), (902, 0), (902, 0)]
    kinds = spark.createDataFrame([("a", 100), ("b", 256)], "container_kind string, capacity_tokens int")
    for shard in (4000, 200):
        got = packing.pack(spark.createDataFrame(items, "doc_id bigint, n_tokens int"), kinds, shard).collect()
        for kind, cap in (("a", 100), ("b", 256)):
            mine = [r for r in got if r.container_kind == kind]
            used = Counter()
            for r in mine:
                used[r.shard, r.container_no] += r.n_tokens
            assert max(used.values()) <= cap and sum(used.values()) == sum(n for _, n in items)
            pieces = defaultdict(list)
            for r in mine:
                pieces[r.doc_id].append((r.first_token, r.n_tokens))
            assert all(len(pieces[i]) == max(1, -(-n // cap)) for i, n in items if i != 902) and len(pieces[902]) == 2
            assert all(a + n == b for p in pieces.values() if len(p) > 1 and p[0][1] for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:]))
            assert sum(used.values()) / cap / len(used) > 0.93
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens int"), kinds).count() == 0


def test_best_fit_respects_every_capacity():
    """Tokens, places and attention cost each hold, and each changes where items go."""
    rng = np.random.default_rng(0)
    n = np.sort(np.minimum(rng.lognormal(2.5, 1.2, 3000).astype(int) + 1, 100))[::-1]
    w = np.array([1.0, 0.1, 0.1])
    rate = 1.5 * float((n**2).sum() / n.sum())
    free = packing.best_fit(n, 100, 1e9, 1e9, w)
    for places, limit in ((4, 1e9), (1e9, rate), (4, rate)):
        where = packing.best_fit(n, 100, places, limit, w)
        assert np.bincount(where, n).max() <= 100 and np.bincount(where).max() <= places
        opened = np.unique(where, return_index=True)[1]
        beside = np.bincount(where, n.astype(float) ** 2) - n[opened].astype(float) ** 2
        assert (beside <= (100 - n[opened]) * limit + 1e-9).all()
        assert where.min() == 0 and len(set(where)) == where.max() + 1 and (where != free).any()


def test_every_constraint_binds_on_documents(spark):
    """With the production parameters, places and attention each change placements of texts with a long tail."""
    rnd = random.Random(2)
    items = spark.createDataFrame([(i, int(rnd.lognormvariate(5, 1.3)) + 1) for i in range(4000)], "doc_id bigint, n_tokens int")
    kinds = spark.createDataFrame([("a", 4096)], "container_kind string, capacity_tokens int")
    run = lambda **x: {(r.doc_id, r.piece_no): r.container_no for r in packing.pack(items, kinds, **x).collect()}
    both = run()
    assert both != run(places=1e9) and both != run(attention=1e9)
    many = spark.createDataFrame([(f"k{i}", 100) for i in range(packing.MOST_KINDS + 1)], "container_kind string, capacity_tokens int")
    with pytest.raises(ValueError):
        packing.pack(items, many)


def test_sainte_lague():
    def slow(seats, votes, most):
        got = [0] * len(votes)
        for _ in range(seats):
            i = max((k for k in range(len(votes)) if got[k] < most[k] and votes[k] > 0), key=lambda k: (votes[k] / (2 * got[k] + 1), -k), default=None)
            if i is None:
                break
            got[i] += 1
        return got

    rnd = random.Random(2)
    for _ in range(200):
        votes = [rnd.choice([0, 1, 2, 3, 5, rnd.random()]) for _ in range(rnd.randrange(1, 7))]
        most = [rnd.choice([0, 2, 1000]) for _ in votes]
        seats = rnd.randrange(0, 90)
        assert sum(mixing.sainte_lague(seats, votes, most)) == sum(slow(seats, votes, most))
        assert mixing.sainte_lague(seats, votes, most) == slow(seats, votes, most) or len(set(votes)) < len(votes)


def test_mixing(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["big"] * 20 + ["mid"] * 5 + ["small", "free", None]), int(rnd.expovariate(1 / 300)) + 1) for i in range(6000)] + [(7000, "big", 0)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens int")
    got = mixing.mix(df, targets, shard_tokens=100_000)
    out = got.collect()
    most = {"big": 1, "mid": 2, "small": 4}
    assert all(r.n_uses <= most[r.source] for r in out) and len({r.doc_id for r in out}) == len(out)
    report = {r.source: r for r in mixing.mix_report(got, targets).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(report[s].reached_share - share) < 0.005
    supply = {s: sum(n for _, x, n in rows if x == s) for s in most}
    goal = min(supply["big"] / 0.5, supply["mid"] * 2 / 0.3, supply["small"] * 4 / 0.2)
    assert sum(r.n_tokens * r.n_uses for r in out) > 0.99 * goal
    assert sorted(map(tuple, mixing.mix(df, targets, shard_tokens=100_000).collect())) == sorted(map(tuple, out))
    assert mixing.mix(df.where("false"), targets).count() == 0
    fine = {r.source: r.reached_share for r in mixing.mix_report(mixing.mix(df, targets, shard_tokens=600), targets).collect()}  # thousands of shards
    assert all(abs(fine[s] - x) < 0.02 for s, x in (("big", 0.5), ("mid", 0.3), ("small", 0.2)))
    with pytest.raises(ValueError):
        mixing.mix(df, spark.createDataFrame([(f"s{i}", 0.1, 1) for i in range(mixing.MOST_SOURCES + 1)], "source string, target_share double, max_repeats int"))
