"""Small tables with the awkward cases: nulls, empty, blank and long texts, copies, repeated rows, extra columns."""

import hashlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, th string, size long"
STEMS = {"en": "the and with from house tree water light stone bring".split(), "de": "der und mit aus haus baum wasser licht stein über".split(), "fr": "le et avec de maison arbre eau lumière pierre été".split()}


def word(i: int, lang: str) -> str:
    h = int(hashlib.md5(f"{i}{lang}".encode()).hexdigest(), 16)
    stems = STEMS[lang]
    return stems[h % 10] + (stems[h // 10 % 10] if h % 3 == 0 else "")


def prose(seed: int, n: int, lang: str = "en") -> str:
    return " ".join(word(seed * 1009 + i, lang) for i in range(n))


def rows():
    """About 150 rows; ids 900 and up are the awkward ones."""
    out = []
    for i in range(120):
        lang = ("en", "de", "fr")[i % 3]
        out.append((i, prose(i, 20 + i * 3 % 70, lang), lang, f"src{i % 4}" if i % 9 else "src0"))
    base = prose(5, 80)
    out += [(200 + i, base, "en", "src0") for i in range(12)]  # exact copies
    out += [(220 + i, base.replace("water", "waters", 1) + f" end{i}", "en", "src1") for i in range(6)]  # near copies
    out += [(900, None, None, None), (901, "", "en", None), (902, " \t\n ", "de", "src2"), (903, "...!?", None, "src9"), (904, "12 34", "en", "zz")]
    out += [(905, prose(77, 4000), "en", "src1"), (906, "x" * 50_000, "en", "src1"), (None, "no id here at all", "en", "src2"), (907, "twice the same row", "en", "src3"), (907, "twice the same row", "en", "src3")]
    out += [(908, "one\ntwo\n\nthree", "en", "src3"), (909, "É È Ü ß ı İ ſ K", "fr", "src3")]
    return [(i, t, lang, s, None if t is None else len(t), "e", "clash", -1) for i, t, lang, s in out]


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)
