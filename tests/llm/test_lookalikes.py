import random
import unicodedata
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from isotrek.llm.lookalikes import LOOK_ALIKES, Rewriter, UnionFind, character_counts, look_alike_classes, look_alike_pairs, read_pairs, same_as, with_appearance
from tests.conftest import rows


def test_union_find_is_transitive():
    u = UnionFind()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")):
        u.join(a, b)
    assert sorted(map(sorted, u.classes())) == [["a", "b", "c", "d"], ["x", "y"]]


def test_properties_of_characters():
    assert [same_as(c) for c in "​­﻿ 　Ａ（ﬁ"] == ["", "", "", " ", " ", "A", "(", "fi"]
    assert [same_as(c) for c in "aA1é²½"] == [None] * 6
    assert same_as("Ⅳ") == "IV" and same_as("𝐀") is None


def test_scripts_and_what_differs_visibly():
    r = Rewriter(look_alike_classes(Counter("AOop" + "ᎪꓮⅠ𐐬ᴏρסɑα−")))
    assert [r(c) for c in "ᎪꓮⅠ𐐬ᴏρ"] == [r(c) for c in "AAIoop"]
    for a, b in (("ס", "o"), ("ɑ", "a"), ("α", "a"), ("−", "-"), ("–", "-"), ("𝐀", "A")):
        assert r(a) != r(b), (a, b)
    assert all(unicodedata.lookup(n) for names in LOOK_ALIKES.values() for n in names)


def test_pairs_of_a_file_join_the_classes(tmp_path):
    file = tmp_path / "pairs.txt"
    file.write_text("# list\n05E1 ;\t006F ;\tMA\t# samekh\n0072 006E ; 006D ; MA\n\n", encoding="utf-8")
    r = Rewriter(look_alike_classes(Counter("omom"), read_pairs(str(file))))
    assert r("סrn") == r("om") == "om" and read_pairs(str(file)) == [("ס", "o"), ("rn", "m")]


def test_counts_are_of_the_corpus(spark):
    df = spark.createDataFrame([("аа", 5), ("aaa", 1), (None, 9)], "t string, n long")
    assert character_counts(df, "t", "n") == Counter({"а": 10, "a": 3}) and character_counts(df, "t") == Counter({"а": 2, "a": 3})


def test_representatives_follow_frequency():
    latin = look_alike_classes(Counter({"a": 9, "а": 2}))
    assert latin["а"] == "a" and latin["Α"] == "A"
    cyrillic = look_alike_classes(Counter({"a": 2, "а": 9}))
    assert cyrillic["a"] == "а" and "а" not in cyrillic


def test_rewriting():
    r = Rewriter(look_alike_classes(Counter("Plaza Mayor é. 12" + "\u200b\ufeff\u00a0\u3000Ｐｌａｚѕ１２（ﬁﬀ")))
    assert r("Ｐｌаｚа Μауοr") == r("Plaza Mayor") == "Plaza Mayor"
    assert r("P​laza﻿") == "Plaza" and r("е́") == r("é") and r("ё") == r("ë")
    assert r("ḉ") == r("ḉ") and r("ﬁn") == r("fin") and r("１２") == "12"
    for a, b in (("Plaza", "plaza"), ("Plaza", "Pláza"), ("P1", "P2"), ("A.B", "A,B"), ("кот", "kot"), ("l", "I"), ("O", "0"), ("²", "2"), ("a b", "a  b")):
        assert r(a) != r(b), (a, b)


def test_pairs_equal_brute_force(spark):
    r = random.Random(3)
    base = ["Plaza Mayor", "Camino Real 12", "ул. Мира", "Estação Sé", "PLAZA MAYOR", "Coco"]
    swaps = {"a": "а", "o": "ο", "c": "с", " ": " ", "e": "е", "P": "Ｐ", "M": "Μ", "C": "С"}
    def noisy(t):
        t = "".join(swaps.get(c, c) if r.random() < 0.3 else c for c in t)
        return t[:2] + "‍" + t[2:] if r.random() < 0.2 else t
    data = [(f"S{i:04}", noisy(r.choice(base))) for i in range(150)] + [(f"H{i:03}", "Plaza Mayor") for i in range(200)]
    data += [("S0001", "Plaza Mayor"), (None, "Plaza Mayоr"), ("N", None), ("E", ""), ("B", "  "), ("I1", "​"), ("I2", "‌"), ("L", "x" * 50_000), ("L2", "х" + "x" * 49_999), ("T", " Plaza Mayor ")]
    rewriter = Rewriter(look_alike_classes(Counter("".join(t for _, t in data if t))))
    classes = defaultdict(set)
    for i, t in data:
        if i and t and t.strip() and rewriter(t.strip()):
            classes[rewriter(t.strip())].add((i, t.strip()))
    want = {(a, b) for c in classes.values() for a, s in c for b, t in c if a < b and s != t}
    df = spark.createDataFrame(data, "id string, name string").withColumn("appearance", F.lit("clash")).withColumn("spelling", F.lit(1))
    got = rows(look_alike_pairs(df, "id", "name"))
    assert len(got) == len(set(got)) and set(got) == want and ("L", "L2") in want and len(want) > 500
    assert look_alike_pairs(df.limit(0), "id", "name").collect() == []
    assert with_appearance(spark.createDataFrame([(None,)], "t string"), "t").first().appearance is None
