"""Small tables for the operator tests: a given one and an odd one."""
import random
import re

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: columns that operators might want for themselves ride along and must come back as they were
CLASH = ["token_count", "leak", "mix", "lang_id", "toxicity", "size", "id", "mark", "held_out"]
ODD_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
              + ", ".join(f"{c} string" for c in CLASH))
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, words: str = "sea tide ebb flood pilot harbour moon buoy log chart") -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words.split()) + (rng.choice(".,;\n") if rng.random() < 0.1 else "") for _ in range(n))


def odd_rows() -> list[tuple]:
    passage = prose(7, 40)
    texts = [
        None, "", " \n\t ", "word", "Two words", passage, passage, passage + " and " + prose(8, 30),
        prose(9, 60) + " " + passage, prose(10, 3000), "a" * 5000, "x " * 4000, "naïve Übergröße 東京 🙂    tail  ",
        "tabs\tand\r\nlines\n\n\nthree  spaces   here ", "<|endoftext|> inside <|endoftext|>", "1 2 3 4 5 6 7 8 9 10 11 12 13 14",
        "don't won't I'll we've 12,5 ...", "A B C D E F G H I J K L M", "a b c d e f g h i j k l m n",
    ]
    rows = [(i, t, None if i % 5 == 0 else "en" if i % 2 else "xx", None if i % 4 == 0 else f"s{i % 3}", len(t or ""),
             *["kept"] * len(CLASH)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, passage, "en", "s1", 1, *["kept"] * len(CLASH)),
             (None, None, None, None, None, *[None] * len(CLASH))]
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA)


def small(spark, name="documents"):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def words(text) -> list[str]:
    return WORD.findall(text or "")


def lower(text) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
