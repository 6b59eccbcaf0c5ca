import pyarrow.parquet as pq
import pytest

from tallyforge.llm import sentences as S

# each text with its sentence ends marked by a bar
CASES = [
    "The U.S. relay kept approx. 24.8 s vs. 7.7 s for release 1.2.3.| npm lost it at 10:10.| Did it really?!| Yes!|",
    "It split models, cursors, etc. for about 3 s.| It split models, locks, etc.| The second pass won.|",
    "We waited ... and it came.| It ended …| The rest followed.|",
    "“Really?!” noted the maintainer, and left.| \"Try again! Later,\" it said at 09:00.| The log said \"it is done.\" and then went quiet.|",
    "\"It is all gone.\"| The rest stays (\"Rolled back. It stopped.\") for now.| 'Fine'.|",
    "Der Lauf hat am 11. März z. B. 10,5 Mio. Euro gekostet.| „Der Index ist voll. Wir warten“, schrieb das Team.|",
    "« Le disque est plein ! Que faire ? » demande l'équipe.| Voir l'art. 8, p. 9 : fini !|",
    "«El índice está lleno. Hay que esperar», escribió el equipo.| ¿Por qué no?| ¡La sesión hija perdió su padre!|",
    "В 2026 г. Отчёт хранит, т. е. жив.| «Индекс полон. Ждём», — написала команда.|",
    "他说：“README.md已经合并。”|日志里写着“读取完成。没有错误。”然后就停了。|我们等了很久……结果还是旧的。|",
    "「main.goを統合した。」と担当者は答えた。|なぜ走査は飛ばしたのか？|",
    "기록에는 \"완료. 오류 없음.\"이라고 적혀 있었다.| scan_test.py 파일은 다시 쓰였다.|",
    "डॉ. लॉग वाले पन्ने में 10 हैं।| लॉग में लिखा था “काम पूरा। कोई त्रुटि नहीं।” और फिर सब रुक गया।|",
    "هل عد الماسح 5 سطر؟| تغير الملف main.go في 05:01.| ثم عادت.|",
    "เมื่อเวลา 06:08 ระบบหยุดทำงาน| ทำไมรุ่น opal-mini ไม่มีราคา| แคชยังเก่าอยู่|",
    "# 1. Overview. Really|\n\n1. First item.|\n\n2. Second item, no mark|\n\n- a line\nbroken in two.|\n\n```\ncode. Is? one!\n\nunit.\n```|\n\nDone.|",
    "> quoted text\n> goes on. | > Then ends|".replace(" | > ", "| "),
    "It was stored earlier.| `After` midnight it stopped.| <b>Which</b> one?| _Tras_ reiniciar.|", "no mark at all|", "Open https://x.test/v1.2/i.html?q=a.b now.|", "credit balance.|Open it.|", "Only one of them.|&nbsp;Suppose it is vendor/basalt-70b.| 4506 jetons restent.| See No. 5.|",
]


@pytest.fixture(scope="module")
def model():
    texts = [t for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    # an abbreviation of the cases that the documents do not use
    return S.train(texts + [f"See No. {i} of the list. It is long." for i in range(40)])


@pytest.mark.parametrize("case", CASES)
def test_cases(model, case):
    text, want, at = "", [], 0
    for part in case.split("|"):
        text += part
        want.append(len(text))
    want = want[:-1] if not case.split("|")[-1] else want
    assert S.sentence_ends(text, model) == want


def test_viterbi_equals_enumeration(model):
    import itertools

    u = next(S.units("A b. C d! E f etc. g. H? I."))
    joints = [S._joint(c, model.stats) for c in S.candidates(u, model.stats) if c.gap != "end"]

    def score(labels):
        out, prev = 0.0, None
        for j, y in zip(joints, labels):
            out += model.pairs.get((prev, y), 0.0) * (prev is not None or y) + (sum(model.weights.get(f, 0.0) for f in S._features(j)) if y else 0.0)
            prev = y
        return out

    best = max(itertools.product((False, True), repeat=len(joints)), key=score)
    assert score(model.decode(joints)) == pytest.approx(score(best))
    fixed = {1: False, 2: True}
    held = max((y for y in itertools.product((False, True), repeat=len(joints)) if all(y[k] == v for k, v in fixed.items())), key=score)
    assert score(model.decode(joints, fixed)) == pytest.approx(score(held))


def test_offsets_with_line_ends_and_prefixes(model):
    text = "  One line\r\nwraps. Two.  \r\n\r\n// a comment\r\n// ends.\r\n\n\n> q\n>\n> r. S\n"
    ends = S.sentence_ends(text, model)
    assert [text[a:b].strip() for a, b in zip([0, *ends], ends)] == ["One line\r\nwraps.", "Two.", "// a comment\r\n// ends.", "> q", ">\n> r.", "S"]
    assert S.sentence_ends("", model) == [] and S.sentence_ends(" \n\t\n", model) == []
    assert S.sentence_ends("```\nnever closed.\n", model) == [17]


def test_table(spark, model):
    rows = [(1, "One. Two!"), (1, "One. Two!"), (2, None), (3, ""), (None, "Alone"), (4, "Word. " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "7 as end_char", "'x' as sentence")
    out = S.split_sentences(df, model)
    assert S.split_sentences(df, S.fit(df)).where("doc_id = 4").count() >= 1
    got = [(r.doc_id, r.end_char) for r in out.where("doc_id = 1 or doc_id is null").collect()]
    assert sorted(got, key=str) == sorted([(1, 4), (1, 9)] * 2 + [(None, 5)], key=str)
    assert out.where("doc_id = 4").count() == 20_000
    empty = df.where("false")
    assert S.split_sentences(empty, S.fit(empty)).count() == 0


def test_statistics_of_all_documents(spark):
    texts = [f"copper-api waits … lumen{i % 9} ends the {i}th run, approx. {i} rows. Then copper-api stops." for i in range(60)] + [f"copper-api begins no. {i}." for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, None), (99, " ")], "doc_id bigint, text string").repartition(4)
    stats, own = S.fit(df, docs=1).stats, S.text_stats(texts)
    assert (stats.ends, stats.begins, stats.ratio) == (own.ends, own.begins, own.ratio)
    assert {k: round(v, 9) for k, v in stats.classes.items()} == {k: round(v, 9) for k, v in own.classes.items()}
    assert stats.ends["approx", "word"][:2] == (0, 60) and stats.opens("copper-api") and not stats.opens("lumen")


def test_joints_of_held_out_documents(spark):
    """Units of texts that the model has not seen, run together: their ends are boundaries, and inner marks before lower case mostly none."""
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    texts = [t for t in table if t]
    model = S.train(texts[::2])
    hits = ends = 0
    for t in texts[1::2]:
        for u, joints in S._joined(t):
            got = set(S.sentence_ends(u.text, model))
            marked = {c.end for c in S.candidates(u, model.stats)} & joints
            hits, ends = hits + len(got & marked), ends + len(marked)
    assert ends > 2_000 and hits / ends > 0.99


def test_long_words_and_addresses(model):
    long = "a/" * 5_000 + "end"
    assert S.sentence_ends(f"It reads {long}. Then it stops.", model) == [len(long) + 10, len(long) + 25]
    assert len(S.sentence_ends("A.B" * 20_000, model)) >= 1
