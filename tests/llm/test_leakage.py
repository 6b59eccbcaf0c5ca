import random

from tallyforge.llm import leakage as L

ITEM = "Suppose the Wenlumba ledger lists 437 requests and the zirwendro rule moves every 726 of them into bucket eckecksab before the day closes."
ZH = "重启之后扫描器Ulmquocor重新读取901行，并丢弃joreckcor已经保存过的快照zirbaulm。当Pelsabnor加上660个缓存词元时会显示多少。"


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id bigint, text string"),
            spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(items)], "item_id bigint, lang string, text string"))


def found(spark, docs, items, **kw):
    out = L.leaks(*frames(spark, docs, items), **kw)
    return {(r.doc_id, r.item_id) for r in out.where("windows > 0").collect()}


def cut(n, start=3):
    return " ".join(ITEM.split()[start:start + n])


def test_disguises(spark):
    docs = [
        cut(12), cut(11), cut(12).upper(), "> " + cut(12).replace(" ", "\n> "), cut(12).replace(" ", ", "), cut(12).replace("r", "r​"), cut(12).replace(" ", "&nbsp;"),
        " ".join(f"<b>{w}</b>" if k % 2 else f"_{w}_" for k, w in enumerate(cut(12).split())), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in cut(12)),
        cut(12).replace("437", "438"), "noise " + cut(14) + " noise", cut(6) + " and then " + cut(6, 9),
        ZH[5:40], ZH[5:20], ZH[5:40].replace("，", "\n").replace("重新", "重 新"), None, "", "   ",
    ]
    assert found(spark, docs, [("en", ITEM), ("zh", ZH), ("en", "too short"), ("en", None), (None, "")]) == {(i, 0) for i in (0, 2, 3, 4, 5, 6, 7, 8, 10)} | {(12, 1), (14, 1)}


def test_blocks_of_items_and_repeats(spark):
    docs = [cut(20, 0), cut(20, 0), "x " * 50_000 + cut(13)]
    want = {(d, i) for d in range(3) for i in range(2)}
    items = [("en", ITEM), ("en", "Well. " + ITEM)]
    assert found(spark, docs, items) == found(spark, docs, items, block_windows=10) == want
    doubled = L.leaks(frames(spark, docs, items)[0].unionAll(frames(spark, docs, items)[0]), frames(spark, docs, items)[1])
    assert doubled.count() == len(want)
    assert found(spark, docs, []) == set() and found(spark, [], items) == set()


def test_candidates_cover_the_radius():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choices(words, k=30)) for _ in range(40)]
    index = L.Index.build(list(range(40)), items, False, 12, 3)
    probes, *_ = L._windows([" ".join(rng.choices(words, k=12)) for _ in range(50)] + [" ".join(i.split()[2:14]) for i in items], False, 12)
    d, w = index.candidates(probes)
    want = {(i, j) for i, p in enumerate(probes.tolist()) for j, q in enumerate(index.prints.tolist()) if (p ^ q).bit_count() <= 3}
    assert set(zip(d.tolist(), w.tolist())) == want and len(want) >= 40


def test_similarity():
    a = "a b c d e f".split()
    assert L.similarity(a, a) == 1.0 and L.similarity(a, "a b c d e x".split()) < 1
    assert L.similarity(a, "u v w x y z".split()) == 0.0


def test_near_passages_are_told_from_exact(spark):
    long = " ".join(f"item{i}" for i in range(30))
    near = long.replace("item11", "other")
    out = L.leaks(*frames(spark, [near, long], [("en", long)]), n_words=30, radius=20).collect()
    got = {r.doc_id: (r.windows, r.similarity) for r in out}
    assert got[1] == (1, 1.0) and (0 not in got or got[0][0] == 0)


def test_near_passages_equal_brute_force(spark):
    rng = random.Random(6)
    light, heavy = [f"w{'abcdefghij'[i]}" for i in range(10)], [f"longword{i}" for i in range(60)]
    items = [" ".join(rng.sample(light, 3) + rng.sample(heavy, k - 3)) for k in (12, 12, 12, 13, 20)]
    docs = []
    for item in items:
        for edit in ([], ["x"], ["x", "y"], None):
            ws = item.split()[:12]
            k = rng.randrange(12) if edit is None else 0
            ws[k:k + 1] = ["other"] if edit is None else edit
            docs += [" ".join(ws), " ".join(rng.choices(light, k=4) + ws + rng.choices(light, k=3))]

    def best(doc, item):
        d, t = doc.split(), item.split()
        if not {tuple(d[k:k + 5]) for k in range(len(d))} & {tuple(t[k:k + 5]) for k in range(len(t) - 4)}:
            return 0.0
        spans = [(d[a:a + 12], t[b:b + 12]) for a in range(max(len(d) - 11, 1)) for b in range(len(t) - 11)]
        return max([L.similarity(x, y) for x, y in spans + [(d[a:a + len(t)], t) for a in range(len(d))]], default=0.0)

    out = L.leaks(*frames(spark, docs, [("en", i) for i in items])).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in out}
    want = {(i, j): s for i, d in enumerate(docs) for j, t in enumerate(items) if (s := best(d, t)) >= L.SIMILARITY}
    assert got == want and sum(r.windows == 0 for r in out) >= 5
    found = L.leaks(*frames(spark, docs, [("en", i) for i in items]), near=False).where("windows = 0").count()
    assert found < sum(r.windows == 0 for r in out)


def test_recall_of_edited_items(spark):
    rng = random.Random(4)
    en = [(i, "en", " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(90))) for i in range(12)]
    zh = [(100 + i, "zh", "".join(rng.choices("的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出", k=150))) for i in range(6)]
    df = spark.createDataFrame([*en, *zh, (200, "en", "too short"), (201, None, None), (202, "en", "")], "item_id bigint, lang string, text string")
    got = {r.kind: r for r in L.edit_recall(df).collect()}
    assert set(got) == {"replace", "drop", "swap"} and all(r.planted == 20 and r.found == r.similar for r in got.values())
    assert got["drop"].similar >= 10
    assert L.edit_recall(df.where("false")).count() == 0
