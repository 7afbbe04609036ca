"""op7: a format of which every string is a real entity."""

import re

from spreadlake.llm import surrogates


def test_no_free_string(spark):
    names = [f"{c}i" for c in "BCDFGHJKLMNPQRSTVWXZ"]
    df = spark.createDataFrame([(i, f"Mr {n} came.") for i, n in enumerate(names)], "doc_id long, text string")
    new = [re.fullmatch(r"Mr (\w+) came\.", r["text"])[1] for r in surrogates.pseudonymise(df, b"k").collect()]
    assert len(set(new)) == len(names) and not set(new) & set(names)
