"""Line rules and what becomes of documents."""

import random
from collections import Counter

from rankloom.llm import line_cleaning
from rankloom.llm.common import split_words
from rankloom.llm.line_cleaning import Limits, judge


def prose(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(3, 9))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 or i == n - 1 else "") for i, w in enumerate(words))


def plain_repeats(words):
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    return len({i + d for i, w in enumerate(windows) if count[w] > 1 for d in range(3)})


def test_repeats_by_definition():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice("abcd") for _ in range(rng.randrange(40))]
        assert line_cleaning.repeated_words(words) == plain_repeats(words)


def test_each_rule_removes_its_lines():
    good = prose(60)
    cases = {
        "home | news | about | contact": "navigation", "Shop > Shoes > Red": "navigation", "All Rights Reserved.": "boilerplate",
        "This work is licensed under the MIT licence.": "boilerplate", "no sentence ends in this line": "punctuation",
        "BUY!! NOW!! CHEAP!! YES!!": "punctuation", "#a $b %c fine.": "punctuation",
    }
    for line, rule in cases.items():
        row = judge(f"{good}\n{line}", Limits())
        assert row[f"n_{rule}"] == 1 and sum(row[f"n_{k}"] for k in line_cleaning.KINDS) == 1, line
        assert row["cleaned"] == good and row["kept"]
    row = judge(f"{good}\n\n{good}", Limits())
    assert row["n_boilerplate"] == row["n_dup_lines"] == 1 and row["base_failed"]


def test_documents_that_lose_too_much_go():
    good, bad = prose(60), prose(70, 3).replace(".", "")
    assert judge(good, Limits())["kept"]
    row = judge(f"{good}\n{bad}", Limits())
    assert not row["base_failed"] and not row["kept"] and row["lost_chars"] * 2 > row["word_chars"]
    assert judge(f"{good}\n{bad}", Limits(lost=60))["kept"]
    long_line = " ".join(prose(90, s) for s in range(300)) + " and so on without an end"
    assert judge(long_line, Limits())["kept"]


def test_other_alphabets_keep_their_endings():
    assert judge(" ".join(["слово"] * 3 + [f"слово{i}" for i in range(60)]) + " конец.", Limits())["kept"]
    assert judge("\n".join(" ".join(f"字{i}{j}" for j in range(9)) + " 完。" for i in range(8)), Limits())["kept"]


def test_odd_rows(odd):
    rows = line_cleaning.clean_lines(odd.withColumnRenamed("key", "kept")).collect()
    assert len(rows) == odd.count()
    for row in rows:
        words = split_words(row.text)
        assert row.n_words == len(words) and row.word_chars == sum(map(len, words)) and row.n_repeat_words == plain_repeats(words)
        assert row.base_failed == (len(words) < 50 or 2 * plain_repeats(words) > len(words))
        assert row.cleaned is not None and not (row.base_failed and row.kept)
    assert line_cleaning.clean_lines(odd.limit(0)).collect() == []


def test_clean_documents_stay(spark, folder, documents):
    rows = line_cleaning.op12_line_cleaning(spark, folder)
    assert rows.count() == documents.count()
    marked = rows.join(spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1"), "doc_id")
    assert marked.filter("NOT kept AND NOT base_failed").count() == 0
    assert rows.filter("NOT kept AND NOT base_failed").count() > 0
