import random

from llm_helpers import prose

from sonarlake.llm import quality


def test_common_lines_leave_the_texts(spark):
    """Lines that a host's documents share go, with their repeats and in any case; other hosts' copies, blank lines and null texts stay."""
    rng = random.Random(6)
    own = [prose(rng, 60) for _ in range(14)]
    rows = [(i, f"Home |  About us\n{t}\n\n home | about US\nall rights reserved", "a") for i, t in enumerate(own[:12])]
    rows += [(20, f"Home | About us\n{own[12]}", "b"), (21, None, "a"), (22, "", "a"), (23, own[13] + "\nall rights reserved once more", "a"), (24, "all rights reserved", "a")]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [got[i]["text_left"] for i in range(12)] == [f"{t}\n" for t in own[:12]]
    assert all(got[i]["text_left"] == t for i, t, _ in rows[12:16]) and got[24]["text_left"] == "" and got[24]["n_removed_words"] == 3
    assert all(got[i]["kept"] and got[i]["n_removed_words"] == 7 for i in range(12))
