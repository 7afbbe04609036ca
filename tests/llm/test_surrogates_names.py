"""op7: names part by part."""

import re

from spreadlake.llm import surrogates


def test_untitled_mentions(spark):
    text = "Anna called. Dr Anna Berger came, Berger said; Dr Berger and Anna Berger's note. Bergerac is a town."
    df = spark.createDataFrame([(1, text), (2, "Frau Berger left.")], "doc_id long, text string")
    new = {r["doc_id"]: r["text"] for r in surrogates.pseudonymise(df, b"k").collect()}
    assert not re.search(r"\bAnna\b|\bBerger\b", new[1]) and "Bergerac is a town." in new[1]
    first, last = re.search(r"Dr (\w+) (\w+) came, ", new[1]).groups()
    assert new[1] == text.replace("Bergerac", "\0").replace("Anna", first).replace("Berger", last).replace("\0", "Bergerac")
    assert new[2] == f"Frau {last} left."
