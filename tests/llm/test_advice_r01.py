
from driftloom.llm import decontam, substring


def test_windows_of_equal_low_hashes_are_told_apart(spark):
    shared = " ".join(f"w{k}" for k in range(18))
    # Windows of one anchor whose 64-bit hashes agree in the low 32 bits.
    pairs = [((76, 84), (314, 376)), ((77, 27), (387, 315)), ((63, 302), (124, 91)), ((26, 294), (89, 101))]
    rows = [(2 * k + j, f"a{a} {shared} b{b}") for k, p in enumerate(pairs) for j, (a, b) in enumerate(p)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(8, "doc_id")
    assert {r.doc_id: r.n_removed for r in substring.substring_dedup(df).collect()} == {k: 0 for k in range(8)}


def test_items_of_mostly_numbers_match_word_for_word(spark):
    item = "What is 12 + 35 + 7 + 81 + 9 + 14 + 22?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    filler = "the river ran slowly past an old mill and nobody came there in winter"
    rows = [(0, f"{filler}. {item} {filler}."), (1, f"{filler} {item} {filler}."), (2, f"{filler}. {item.replace('35', '36')} {filler}."), (3, filler), (4, item)]
    found = {r.doc_id: r for r in decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(found) == {0, 1, 4}
    assert all(r.verbatim and r.n_item == 9 for r in found.values()) and found[0].n_matched == found[4].n_matched == 9
