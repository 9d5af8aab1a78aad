"""Headers and columns at once against one after the other."""

import random

from tarifflow.operators import tables

SCHEMA = "doc_id string, sheet string, row_pos int, cells array<string>"
SAID = ["Наименование", "услуги", "Услуга", "Код ", "цена", "Цена резидент", "стоимость для снг", "Тариф", "МКБ", "Название", "тенге", "нерезидент", "рк цена", "", None, " ", "Анализ", "1500", "ЦЕНА №２", "é", "(страхов) тариф"]


def test_at_once_equals_step_by_step(spark):
    rng = random.Random(1)
    rows = []
    for doc in range(120):
        for row in rng.sample(range(100), rng.choice([0, 1, 3, 40, 90])):
            few = rng.random() < 0.8
            rows.append((f"d{doc}", rng.choice("st"), row, None if rng.random() < 0.02 else [rng.choice(SAID[13:] if few else SAID) for _ in range(rng.randrange(7))]))
    rows = list({(d, s, r): (d, s, r, c) for d, s, r, c in rows}.values())
    frame = spark.createDataFrame(rows, SCHEMA)
    for compatibility in (True, False):
        headers = tables.pick_headers(frame, compatibility=compatibility)
        steps = headers.join(tables.column_map(tables.merged_headers(frame, headers, compatibility=compatibility)), ["doc_id", "sheet"])
        once = tables.headers_and_columns(frame, compatibility=compatibility)
        want = {(r["doc_id"], r["sheet"]): tuple(r[c] for c in once.columns[2:]) for r in steps.collect()}
        got = {(r["doc_id"], r["sheet"]): tuple(r[2:]) for r in once.collect()}
        assert {k: got[k] for k in want} == want and len(want) > 60
        # headers whose rows have no cell at all
        assert all(v[1:] == (None,) * 5 for k, v in got.items() if k not in want)


def test_items_need_two_scans(spark, tmp_path):
    rows = [("d", "s", k, c) for k, c in enumerate([["x"], ["Код", "Наименование", "Цена"], ["1", "Анализ", "700"], ["2", "Осмотр", "0"]])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "cells"))
    found = tables.items_of_tables(spark.read.parquet(str(tmp_path / "cells")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
    assert [(r["service_name_raw"], r["source_row"]) for r in found.collect()] == [("Анализ", 3)]
