"""Stems and chunks on literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from granary.functions import stem as st
from granary.functions import text as tx
from granary.operators import chunks as nc
from tests import plain_chunks as ck

GROUPS = """скважина скважины скважине скважинный скважинного скважинных
насос насоса насосу насосом насосы насосов насосами
устанавливать устанавливает устанавливается
уплотнение уплотнения уплотнений
работает работать работы работа работой
декларация декларации декларацией
давление давления давлением
клапан клапана клапаны клапанов клапаном
температура температуры температуре
фильтр фильтра фильтры фильтров
двигатель двигателя двигателем двигатели
кабель кабеля кабелем кабели""".splitlines()


def stems(spark, words):
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string")
    return [r["s"] for r in df.select("k", st.normalized(F.col("w")).alias("s")).orderBy("k").collect()]


def test_forms_of_a_word_meet(spark):
    words = [w for g in GROUPS for w in g.split()]
    found = dict(zip(words, stems(spark, words)))
    assert [len({found[w] for w in g.split()}) for g in GROUPS] == [1] * len(GROUPS)


def test_codes_and_short_words_stay(spark):
    words = ["500095.f", "2eco6-38", "gru-45", "wrp-a", "м3", "ip68", "", "и", "на", "abc", None]
    assert stems(spark, words) == words
    assert stems(spark, ["-насос.", "/м3"]) == ["насос", "м3"]


def test_other_words_stay_apart(spark):
    a = stems(spark, ["насос", "подача", "фильтр", "клапан"])
    b = stems(spark, ["напор", "давление", "фланец", "колесо"])
    assert all(x != y for x, y in zip(a, b))


def test_tokens(spark):
    df = spark.createDataFrame([("Насосы и 3,6 м³/час для скважины SP-45.",), (None,)], "t string")
    assert [r[0] for r in df.select(st.search_tokens(F.col("t"))).collect()] == [["насос", "3.6", "м3/ч", "скважин", "sp-45"], None]


def table(n):
    return "\n".join(["Модель | Напор макс., м | Подача, м3/ч"] + [f"Водомет {50 + i}/{60 + i} | {60 + i} | 3.{i % 9}" for i in range(n)])


def test_every_piece_of_a_table_has_its_header():
    pieces = [c["text"] for c in ck.chunks(["ХАРАКТЕРИСТИКИ\n" + table(120)])]
    assert len(pieces) > 1 and all(p.startswith("Модель |") and len(p) <= ck.TARGET for p in pieces)
    rows = [r for p in pieces for r in p.splitlines()[1:]]
    assert rows == table(120).splitlines()[1:]


def test_short_table_and_cards():
    text = "ХАРАКТЕРИСТИКИ ИЗДЕЛИЯ\nНапор максимальный, м | 75\nПодача номинальная, м3/ч | 3.6\nМощность, Вт | 1150\nМасса, кг | 12"
    (only,) = ck.chunks([text])
    assert only["heading"] == "ХАРАКТЕРИСТИКИ ИЗДЕЛИЯ" and only["text"] == text.split("\n", 1)[1]
    card = "Водомет {} обеспечивает напор до 75 метров и подачу 3.6 кубометра в час, вес 12 кг, кабель 30 метров в комплекте."
    cards = ck.chunks(["ОПИСАНИЕ МОДЕЛЕЙ\n" + card.format("55/75") + "\n" + card.format("60/92")])
    assert [c["text"] for c in cards] == [card.format("55/75"), card.format("60/92")]


def test_chain_of_headings_over_pages():
    body = "Обычный текст раздела, достаточно длинный для фрагмента."
    out = ck.chunks(["КАТАЛОГ\nНАСОСЫ СКВАЖИННЫЕ\n" + body, "x", "продолжение таблицы и текста на следующей странице", "НОВЫЙ РАЗДЕЛ\n" + body])
    assert [(c["heading"], c["page"]) for c in out] == [("КАТАЛОГ › НАСОСЫ СКВАЖИННЫЕ", 1), ("КАТАЛОГ › НАСОСЫ СКВАЖИННЫЕ", 3), ("КАТАЛОГ › НАСОСЫ СКВАЖИННЫЕ › НОВЫЙ РАЗДЕЛ", 4)]
    caps = "ДЖИЛЕКС ВОДОМЕТ 55/75\nНАПОР МАКС 75 М\nПОДАЧА 3.6 М3/Ч"
    assert ck.chunks([caps])[0]["text"] == caps


def test_pieces_of_paragraphs():
    whole = "Руководство по монтажу. " * 400
    pieces = [c["text"] for c in ck.chunks([whole.strip()])]
    assert len(pieces) > 1 and all(ck.LEAST <= len(p) <= 2 * ck.TARGET for p in pieces)
    paragraphs = [f"Абзац {k} " + "слово " * 100 for k in range(6)]
    got = ck.packed("\n\n".join(paragraphs))
    assert len(got) == 5 and got[1].startswith(got[0][-ck.OVERLAP :].strip())


def native(spark, docs):
    """Chunks by the operator: key -> list of (heading, text, page)."""
    df = spark.createDataFrame(list(enumerate(docs)), "k long, pages array<string>").repartition(3)
    out = {}
    for r in sorted(nc.document_chunks(df, "k", "pages").collect(), key=lambda r: (r["k"], r["ord"])):
        own = out.setdefault(r["k"], [])
        assert r["ord"] == len(own)
        own.append((r["heading"], r["text"], r["page"]))
    return out


def canonical(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "k long, pages array<string>")
    return [r[1] for r in sorted(df.select("k", F.transform("pages", tx.chunk_text)).collect())]


def test_the_operator_equals_the_plain_version(spark):
    rng = random.Random(4)
    words = "насос вода скважина pump water напор 55/75 кабель".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    kinds = [
        lambda: "# " + say(2), lambda: f"{rng.randint(1, 9)}.{rng.randint(1, 9)} Раздел " + say(2), lambda: "ЗАГОЛОВОК " + rng.choice("АБВ"), lambda: say(rng.randint(1, 40)) + ".",
        lambda: "", lambda: "  ", lambda: say(2) + " | " + say(1), lambda: "Водомет 55/75 " + say(12), lambda: say(500), lambda: "a | b | " + say(3), lambda: "|", lambda: "#", lambda: "КАТАЛОГ.",
    ]

    def page():
        out = []
        for _ in range(rng.choice([0, 1, 3, 12, 30])):
            out += [rng.choice(kinds)()] * 1 if rng.random() < 0.8 else [kinds[6]() for _ in range(rng.choice([2, 60]))]
        return "\n".join(out)

    docs = [[rng.choice([None, page(), page(), page()]) for _ in range(rng.choice([0, 1, 2, 4]))] for _ in range(120)]
    docs += [["ДЖИЛЕКС ВОДОМЕТ 55/75\nНАПОР МАКС 75 М\nПОДАЧА 3.6 М3/Ч", "текст страницы, достаточно длинный для того чтобы остаться"], ["x" * 9000], ["короткий", None], [("строка " * 60 + "\n") * 12]]
    got = native(spark, docs)
    for k, pages in enumerate(canonical(spark, docs)):
        want = [(c["heading"], c["text"], c["page"]) for c in ck.chunks(pages)]
        assert got.get(k, []) == want, docs[k]


def test_the_given_texts(spark):
    docs = [[r["text"]] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = native(spark, docs)
    for k, pages in enumerate(canonical(spark, docs)):
        assert got.get(k, []) == [(c["heading"], c["text"], c["page"]) for c in ck.chunks(pages)]


@pytest.mark.parametrize("page", [None, "", " ", "short"])
def test_pages_without_text(spark, page):
    assert native(spark, [[page]]) == {}
