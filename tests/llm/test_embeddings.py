"""Near-duplicate vectors against all pairs of each label."""

import numpy as np

import __spark_entry__ as entry
from tidemark.llm import embedding_dedup, graph


def brute(rows, least=0.93):
    """{vec_id: (n_links, component)} by all pairs; rows are (vec_id, vector, label)."""
    links = {r[0]: set() for r in rows}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[2] is not None and a[2] == b[2] and len(a[1] or []) == len(b[1] or []) > 0:
                x, y = np.array(a[1], dtype=float), np.array(b[1], dtype=float)
                norm = np.sqrt((x * x).sum() * (y * y).sum())
                if np.isfinite(norm) and norm > 0 and (x * y).sum() / norm >= least:
                    links[a[0]].add(b[0])
                    links[b[0]].add(a[0])
    return links


def component(links, start):
    seen, todo = {start}, [start]
    while todo:
        for other in links[todo.pop()] - seen:
            seen.add(other)
            todo.append(other)
    return min(seen)


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(200, 260)] + [(7, 7), (8, 9), (9, 8), (None, 3)]
    roots = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(roots[i] == 100 for i in range(100, 161)) and all(roots[i] == 1 for i in range(200, 260))
    assert roots[8] == roots[9] == 8 and 7 not in roots and 3 not in roots
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_all_pairs(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    links = brute([(r.vec_id, r.embedding, r.label) for r in table])
    out = entry.queries()["op1_embedding_near_dedup"](spark, folder).collect()
    assert len(out) == len(table)
    found = sum(r.n_links for r in out)
    assert found <= sum(map(len, links.values())) and found >= 0.99 * sum(map(len, links.values()))
    assert sum(r.component_id == component(links, r.vec_id) for r in out) >= 0.99 * len(out)
    assert all(r.kept == (r.vec_id == r.component_id) and r.n_links <= len(links[r.vec_id]) for r in out)


def test_groups_larger_than_a_window_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.05 * rng.standard_normal(16)).tolist(), 1) for i in range(300)]
    rows += [(i, rows[0][1], 1) for i in range(300, 340)]  # exact copies
    rows += [(400, rows[0][1], 2), (401, rows[0][1], None), (402, [0.0] * 16, 1), (403, None, 1), (404, [], 1),
             (405, [float("nan")] * 16, 1), (406, [None] * 16, 1), (407, rows[0][1][:8], 1), (408, rows[0][1][:8], 1),
             (409, [1e300] * 16, 3), (410, [1e-300] * 16, 3)]
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), window=4, passes=6, block=64
    ).collect()}
    plain = [r for r in rows if r[0] < 402 or r[0] in (407, 408)]
    links = brute(plain)
    for vec, *_ in plain:
        assert out[vec].n_links == len(links[vec]), vec
        assert out[vec].component_id == component(links, vec)
    for vec in (402, 403, 404, 405, 406):
        assert (out[vec].n_links, out[vec].component_id, out[vec].kept) == (0, vec, True)
    assert out[410].component_id == 409


def test_repeated_null_keys_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (None, None, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = embedding_dedup.near_duplicates(frame).collect()
    assert sorted(r.n_links for r in out) == [0, 0, 1, 1]
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_passes_grow_with_the_label_and_its_concentration(spark):
    rng = np.random.default_rng(4)
    around = rng.standard_normal((2000, 16)) + 4.0 * (np.arange(16) == 0)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(around)] + [(5000 + i, v.tolist(), 2) for i, v in enumerate(around[:30])]
    classes = embedding_dedup.vector_classes(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label"
    )
    plans = {r.label: r for r in embedding_dedup.label_plans(classes, 0.98, 2, 4, 0.01).collect()}
    assert plans[2].passes == 0 and plans[1].n == 2000 and 2 < plans[1].passes < 250
    unit = around / np.linalg.norm(around, axis=1, keepdims=True)
    assert np.allclose(plans[1].mean, unit.mean(axis=0))
    m = float((unit.mean(axis=0) ** 2).sum())
    hit = (1 - np.arccos((0.98 - m) / (1 - m)) / np.pi) ** 10
    assert (1 - hit) ** plans[1].passes <= 0.01 < (1 - hit) ** (plans[1].passes - 1)


def test_pairs_of_vectors_around_a_common_direction(spark):
    rng = np.random.default_rng(5)
    common = np.sqrt(32) * np.eye(32)[0]
    one = common + rng.standard_normal((3000, 32))
    noise = rng.standard_normal((150, 32))
    unit = one[:150] / np.linalg.norm(one[:150], axis=1, keepdims=True)
    noise -= (noise * unit).sum(axis=1, keepdims=True) * unit
    two = 0.935 * unit + np.sqrt(1 - 0.935**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(one)] + [(10_000 + i, v.tolist(), 1) for i, v in enumerate(two)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame, passes=2, window=4, block=256).collect()}
    assert sum(out[10_000 + i].component_id == out[i].component_id for i in range(150)) >= 147


def test_sorted_passes_for_labels_of_every_size_and_concentration(spark):
    rng = np.random.default_rng(6)
    spread = np.exp(0.5 * rng.standard_normal((3500, 1)))
    around = rng.standard_normal((3500, 64)) * spread + 45.0 * (np.arange(64) == 0)
    small = rng.standard_normal((200, 64))
    small[100:] = small[:100] + 0.3 * rng.standard_normal((100, 64))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(around)] + [(9000 + i, v.tolist(), 2) for i, v in enumerate(small)]
    rows += [(9900 + i, v.tolist(), 3) for i, v in enumerate(small[:3])] + [(9950, small[0].tolist(), 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    classes = embedding_dedup.vector_classes(frame, "vec_id", "embedding", "label")
    plans = {r.label: r for r in embedding_dedup.label_plans(classes, 0.93, 24, 32, 0.01).collect()}
    assert (plans[1].mean and sum(x * x for x in plans[1].mean)) > 0.93
    assert plans[1].turns == 96 and plans[2].turns == 24 and plans[3].turns == plans[4].turns == 1
    links = embedding_dedup.window_links(classes, embedding_dedup.label_plans(classes, 0.93, 24, 32, 0.01), 0.93, 32, 256, 7)
    known = {r.node: (r.label, r["first"]) for r in classes.collect()}
    assert {known[r.a][0] for r in links.collect()} == {1, 2}  # both labels' links come from sorted passes
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    for label in (1, 2):
        ids = np.array([r[0] for r in rows if r[2] == label])
        unit = np.array([r[1] for r in rows if r[2] == label])
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        near = unit @ unit.T >= 0.93
        lowest = np.arange(len(ids))
        while True:
            new = np.where(near, lowest[None, :], len(ids)).min(axis=1)
            if (new == lowest).all():
                break
            lowest = new
        assert sum(out[i].n_links for i in ids) >= 0.99 * (near.sum() - len(ids))
        assert sum(out[i].component_id == ids[c] for i, c in zip(ids, lowest)) >= 0.99 * len(ids)
        assert all(out[i].n_links <= n - 1 for i, n in zip(ids, near.sum(axis=1)))
