import random
import re
from collections import Counter

from segue.llm import quotes


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text.lower()).strip(" ")


def parse(text):
    """Body, and the passages as lists of lines."""
    lines = []
    for x in re.sub("\r\n?", "\n", text or "").split("\n"):
        m = re.match(quotes.MARKS, x)
        lines.append((m[0].count(">"), re.sub(quotes.MARKS + " ?", "", x)) if m else (0, x))
    body = re.sub(r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "", "\n".join(b for n, b in lines if n == 0))
    passages, last = [], 0
    for n, b in lines:
        if n:
            if n != last:
                passages.append([])
            passages[-1].append(b)
        last = n
    return body, [p for p in passages if normal("\n".join(p))]


def by_hand(rows):
    units = {}
    for c, t, _, x in rows:
        body, _ = parse(x)
        if c is not None and t is not None:
            for part in [body, *re.split(r"\n[ \t]*\n", body), *body.split("\n")]:
                if normal(part):
                    units.setdefault((c, normal(part)), set()).add(t)
    out = []
    for c, t, role, x in rows:
        body, passages = parse(x)
        votes = Counter()
        for p in passages if c is not None and t is not None else []:
            latest = lambda s: max((k for k in units.get((c, normal(s)), ()) if k < t), default=None)  # noqa: B023, E731
            hits = Counter()
            for s in (y for y in p if normal(y)):
                if latest(s) is not None:
                    hits[latest(s)] += 1
            whole = latest("\n".join(p))
            if whole is not None:
                votes[whole] += 1
            elif hits:
                votes[max(hits, key=lambda k: (hits[k], k))] += 1
        reply = max(votes, key=lambda k: (votes[k], k)) if votes else None
        out.append([c, t, role, body, len(passages), sum(votes.values()), reply])
    to = {}
    for c, t, *_, reply in out:
        if reply is not None:
            to[c, t] = min(reply, to.get((c, t), reply))
    for r in out:
        thread, depth, at = r[1], 0, r[6]
        while at is not None:
            thread, depth, at = at, depth + 1, to.get((r[0], at))
        r += [thread, depth]
    return sorted(map(str, out))


def compare(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, body string")
    got = [[r.conv_id, r.turn, r.role, r.body, r.n_quotes, r.n_linked, r.reply_to, r.thread, r.depth] for r in quotes.link(df).collect()]
    assert sorted(map(str, got)) == by_hand(rows)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quotes, "SPAN", 4)
    rng = random.Random(1)
    words = "yes no maybe the plan is Good bad later now".split()
    rows, said = [], {}
    for conv in (1, 2, 3):
        for turn in range(40):
            line = lambda: " ".join(rng.choices(words, k=rng.randint(1, 4)))
            mine = "\n".join(line() if rng.random() < 0.9 else "" for _ in range(rng.randint(1, 4)))
            text = mine
            if turn and rng.random() < 0.6:
                old = rng.choice(said[conv])
                if rng.random() < 0.3:
                    old = rng.choice(old.split("\n"))
                marks = rng.choice(["> ", ">", ">  "])
                text = "\n".join(marks + x for x in old.upper().split("\n")) + rng.choice(["\n", "\n\n"]) + mine
                if rng.random() < 0.3:
                    text = mine + "\n>> nested\n> > " + line() + "\n" + text
            said.setdefault(conv, []).append(text)
            rows.append((conv, turn * 3, rng.choice(["user", "assistant"]), text))
    rows += [(1, 500, None, None), (1, 501, "user", ""), (1, 502, "user", ">"), (None, 3, "user", "> yes"), (2, None, "user", "> no\nok"), rows[5], (1, 15, "user", "> yes\nagain"), (9, 0, "a", "x " * 50000), (9, 1, "b", "> " + "x " * 50000 + "\r\nfine")]
    compare(spark, rows)


def test_chain_and_empty(spark):
    rows = [(1, k, "u", (f"> message {k - 1} here\n" if k else "") + f"message {k} here") for k in range(40)]
    compare(spark, rows)
    compare(spark, [(1, k, "u", ("> same line\n" if k else "") + "same line") for k in range(60)])
    assert quotes.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    got = [[r.conv_id, r.turn, r.role, r.body, r.n_quotes, r.n_linked, r.reply_to, r.thread, r.depth] for r in quotes.op4_chat_format(spark, "/root/testdata/sf0.01").collect()]
    assert sorted(map(str, got)) == by_hand(rows)


def test_places_are_reply_order(spark):
    got = quotes.op4_chat_format(spark, "/root/testdata/sf0.001").collect()
    by_conv = {}
    for r in got:
        by_conv.setdefault(r.conv_id, []).append(r)
    for rows in by_conv.values():
        rows.sort(key=lambda r: (r.thread, r.turn, r.role or "", r.body or ""))
        assert [r.place for r in rows] == list(range(1, len(rows) + 1))
    df = spark.createDataFrame([(1, None, "u", "hi"), (None, 1, "u", "hi"), (1, 200, "u", "yo"), (1, 2, "u", "yes")], "conv_id long, turn long, role string, text string")
    assert sorted(((r.turn, r.place) for r in quotes.link(df).collect()), key=str) == [(1, None), (2, 1), (200, 2), (None, None)]
