import random
import re

from segue.llm import licenses


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            row[j], old = max(row[j], row[j - 1], old + 1 if x == y else 0), row[j]
    return row[-1]


def test_patience_is_an_alignment():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(20))]
        b = [rng.randrange(12) for _ in range(rng.randrange(20))]
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= longest(a, b)
        once = list(dict.fromkeys(a))  # each word once: patience is exact there
        other = rng.sample(once, len(once))
        assert len(licenses.patience(once, other)) == longest(once, other)


PLAIN = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def plain(text):
    return PLAIN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(text, notices=None):
    """Every notice against every stretch, from each of its words to each other, without any filter: the names, and the best coverage."""
    words, found = plain(text), []
    for k, (name, notice) in enumerate((notices or licenses.NOTICES).items()):
        want, best = plain(notice), 0
        hits = [i for i, w in enumerate(words) if w in set(want)]
        for hi in hits:
            for lo in hits:
                if hi - licenses.widest(len(want)) < lo <= hi:
                    best = max(best, len(licenses.patience(words[lo : hi + 1], want)))
        if best >= licenses.LEAST * len(want):
            found.append((-best / len(want), -best, k, name))
    found.sort()
    return [x[3] for x in found], -found[0][0] if found else None


def scanned(texts, notices=None):
    t = licenses.Templates(notices or licenses.NOTICES)
    out = []
    for text in texts:
        run = next(iter(licenses.runs(licenses.pa.array([text], licenses.pa.string()))))
        hashes, _, _, _ = licenses.plain_words(run)
        number = {int(h): k for k, h in enumerate(t.vocab)}
        found = licenses.found_notices([number.get(int(h), -1) for h in hashes], t, list(range(len(t.names))), licenses.LEAST)
        out.append(([t.names[-x[2]] for x in found], found[0][0] if found else None))
    return out


def test_notice_words_before_the_notice():
    """Words of the notice that stand before it, and again in it, take nothing from it."""
    texts = ["Under released: Released under new the MIT License.", "license the MIT " * 3 + "Released under the MIT License. mit under", "the the Licensed under CC BY-NC 4.0. by nc"]
    assert scanned(texts) == [(["mit-line"], 1.0), (["mit-line"], 1.0), (["cc-by-nc-4.0-line"], 1.0)]


def test_random_texts_against_all_stretches():
    rng = random.Random(11)
    notices = {k: licenses.NOTICES[k] for k in ("mit-line", "apache-2.0-line", "gpl-3.0-line", "cc-by-nc-4.0-line", "gpl-3.0")}
    texts = []
    for _ in range(400):
        name = rng.choice(list(notices)[:4])
        words = plain(notices[name])
        body = [w for w in words if rng.random() < 0.9]
        for _ in range(rng.randint(0, 8)):
            body.insert(rng.randrange(len(body) + 1), rng.choice([*words, "zzz", "new"]))
        around = lambda words=words: [rng.choice([*words, "zzz"]) for _ in range(rng.randint(0, 9))]
        texts.append(" ".join([*around(), *body, *around()]))
    assert scanned(texts, notices) == [by_hand(x, notices) for x in texts]


def test_hot_texts_take_bounded_time():
    import time

    rng = random.Random(4)
    mit = plain(licenses.NOTICES["mit"])
    shuffled = [rng.choice(mit) for _ in range(20_000)]
    began = time.perf_counter()
    got = scanned([" ".join(mit * 600), " ".join(shuffled), " ".join(w for k in range(300) for w in mit[k % 7 :])])
    assert got[0] == (["mit"], 1.0) and got[2] == (["mit"], 1.0)
    assert time.perf_counter() - began < 60


def texts():
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice("the of and rights this work software under in notice".split()) for _ in range(n))
    out = [None, "", "...", filler(300)]
    for name, notice in licenses.NOTICES.items():
        out += [notice, f"{filler(50)}\n{notice.upper()}\n{filler(30)}", f"{notice} {notice}", filler(400) + " zzz" * 20000 + " " + notice]
        words = notice.split()
        words[len(words) // 2] = "zzz"
        out.append(filler(10) + " " + " ".join(words))
        out.append(" ".join(words[: len(words) // 3]))
    return out


def test_against_unfiltered(spark):
    rows = [(k, x, "z") for k, x in enumerate(texts())] + [(1, "", "z")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert len(got) == len(rows)
    by_id = {k: x for k, x, _ in rows}
    for r in got:
        if len(plain(by_id[r.doc_id])) < 200:
            assert (r.licenses, r.coverage) == by_hand(by_id[r.doc_id])
        assert r.license == (r.licenses[0] if r.licenses else None)
    whole = {r.doc_id: r for r in got}
    for k, (name, _) in enumerate(licenses.NOTICES.items()):
        assert whole[4 + 6 * k].license == name and whole[4 + 6 * k].coverage == 1
        assert whole[5 + 6 * k].license == name and whole[6 + 6 * k].license == name
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in licenses.op6_license_scan(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        if len(plain(r.text)) < 120:
            assert (got[r.doc_id].licenses, got[r.doc_id].coverage) == by_hand(r.text)
        for name in ("mit-line", "gpl-3.0-line", "apache-2.0-line", "cc-by-nc-4.0-line"):
            if licenses.NOTICES[name] in r.text:
                assert got[r.doc_id].coverage == 1


def test_a_notice_whose_rarest_words_stand_elsewhere(spark):
    """A variant without three words, which the text has once each far away, and its other words twice."""
    notice = licenses.NOTICES["isc"].lower().replace(",", "").replace(".", "").replace("/", " ").split()
    gone = [w for w in dict.fromkeys(notice) if notice.count(w) == 1][:3]
    variant = [w for w in notice if w not in gone]
    far = " ".join(f"{w} " + "zzz " * 60 for w in gone)
    far += " ".join(f"{w} " + "zzz " * 60 for w in sorted(set(variant)))
    (row,) = licenses.scan(spark.createDataFrame([(1, " ".join(variant) + " zzz" * 100 + " " + far)], "doc_id long, text string")).collect()
    assert row.license == "isc" and row.coverage == len(variant) / len(notice)


def test_words_put_in(spark):
    """A notice of which every second word is another, and two notices in one text."""
    mit, isc = (licenses.NOTICES[k] for k in ("mit", "isc"))
    spread = " ".join(f"{w} zzz{k}" for k, w in enumerate(plain(mit)[:-3]))
    (row,) = licenses.scan(spark.createDataFrame([(1, f"{spread} {'yyy ' * 300} {isc}")], "doc_id long, text string")).collect()
    assert row.licenses == ["isc", "mit"] and row.license == "isc"
