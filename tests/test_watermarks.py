import random

from caliperlake.operators import profiles

TEXTS, PAGES = "doc_id long, page_index int, observation_id string, text string, cx double, cy double, angle double", "doc_id long, page_index int, sx double, sy double"


def brute(rows, spacing):
    """Each text as the origin of a lattice."""
    out = set()
    for page in {r[:2] for r in rows}:
        mine, (sx, sy) = [r for r in rows if r[:2] == page], spacing[page]
        for r in mine:
            cells = []
            for q in mine:
                c, k = round((q[4] - r[4]) / sx), round((q[5] - r[5]) / sy)
                if abs(q[4] - r[4] - c * sx) <= 2 and abs(q[5] - r[5] - k * sy) <= 2:
                    cells.append((c, k))
            if len(mine) >= 9 and len(cells) == len(set(cells)) >= 9 and len({c for c, _ in cells}) >= 2 and len({k for _, k in cells}) >= 3:
                out |= {q[2] for q in mine}
                break
    return out


def test_lattices_are_found_as_by_brute_force(spark):
    rng, rows, spacing = random.Random(8), [], {}
    for doc in range(60):
        sx, sy = rng.choice([(100.0, 80.0), (65.0, 80.0), (50.0, 50.0), (4.0, 3.0)])
        spacing[doc, 0] = (sx, sy)
        shift, x0, y0 = rng.choice([0.5, 1.0, 1.9, 2.6]), rng.uniform(-5, 70), rng.uniform(-5, 70)
        for k in range(12):
            if rng.random() < 0.95:
                rows.append((doc, 0, f"{doc}:{k}", "样张", x0 + k % 3 * sx + rng.choice([0, shift]), y0 + k // 3 * sy - rng.choice([0, shift]), 330.0))
        if rng.random() < 0.3:
            rows.append((doc, 0, f"{doc}:x", "样张", rng.uniform(0, 200), rng.uniform(0, 200), 330.0))
    want = brute(rows, spacing)
    assert 0 < len(want) < len(rows)
    pages = spark.createDataFrame([(*p, *s) for p, s in spacing.items()], PAGES)
    assert {r.observation_id for r in profiles.watermarks(spark.createDataFrame(rows, TEXTS), pages).collect()} == want


def test_a_page_of_many_equal_texts(spark):
    texts = spark.range(20_000).selectExpr("1L AS doc_id", "0 AS page_index", "CAST(id AS STRING) AS observation_id", "'x' AS text", "CAST(id * 37 % 19997 / 20 AS DOUBLE) AS cx", "CAST(id * 101 % 19991 / 20 AS DOUBLE) AS cy", "330.0D AS angle")
    assert profiles.watermarks(texts, spark.createDataFrame([(1, 0, 100.0, 80.0)], PAGES)).count() == 0
