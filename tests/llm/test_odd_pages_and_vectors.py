"""Pages that make a tokeniser search again and again, tables of many spans, and vectors of extreme size."""

from __future__ import annotations

import time

import numpy as np
import pytest

from shelfwatch.llm import html_text, vector_search

REPEATED = {"start tags and quotes": 'x<a&quot;"', "bare start tags": "<a", "quotes in quotes": "<a \"'>", "quotes that never end": "<a x=\"y'>\"", "end tags": "</a", "attributes": '<a b="', "row spans": "<tr><td rowspan=65000>x",
            "row spans of many ends": "<tr><td rowspan=9>x<td>y", "tall cells": None}


def page(kind, n):
    if kind == "tall cells":
        return "<table><tr>" + "<td>x" * n + "<td>" + "y<br>" * n + "</table>"
    return ("<table>" if "spans" in kind else "") + REPEATED[kind] * n


@pytest.mark.parametrize("kind", REPEATED)
def test_time_grows_as_the_page(kind):
    """Eight times the page takes less than 24 times as long (64 times if it grew with the square)."""
    def took(n):
        html, best = page(kind, n), 1e9
        for _ in range(3):
            begin = time.process_time()
            html_text.text_of(html)
            best = min(best, time.process_time() - begin)
        return best

    assert took(16000) < 24 * max(took(2000), 0.004)


def test_rests_of_start_tags():
    """Once a quote is found to run to the page's end, tags end as if nothing had been looked up."""
    parts = ["<a ", "<b>", "'", '"', ">", "x", "<p class='a>b'>", "y ", '<i q="', "</a>"]
    rnd = np.random.default_rng(5)
    for _ in range(3000):
        html = "".join(parts[k] for k in rnd.integers(0, len(parts), rnd.integers(1, 25)))
        known, fresh = html_text._Rests(html), html_text._Rests(html)
        known._learn()
        for place in range(len(html) + 1):
            m = html_text.REST.match(html, place)
            want = (m[1], m.end()) if m else (lambda b: (b[1], b.end()))(html_text.BARE_REST.match(html, place))
            assert known.at(place) == want == fresh.at(place)


def test_cells_below_spans_stand_where_the_grid_is_free():
    """Against a grid that is filled cell by cell, for spans that don't overlap."""
    rnd = np.random.default_rng(7)
    for _ in range(2000):
        rows = [[(int(rnd.integers(1, 5)), 1) if rnd.random() < 0.6 else (1, int(rnd.integers(1, 4))) for _ in range(rnd.integers(0, 5))] for _ in range(rnd.integers(1, 8))]
        taken, want, overlap = set(), [], False
        for r, row in enumerate(rows):
            column, own = 0, []
            for high, wide in row:
                while (r, column) in taken:
                    column += 1
                cells = {(r + i, column + j) for i in range(high) for j in range(wide)}
                overlap |= bool(cells & taken)
                taken |= cells
                own.append(column)
                column += wide
            want.append(own)
        if overlap:
            continue
        nodes = [[html_text.Node("td", f" rowspan={h} colspan={w}") for h, w in row] for row in rows]
        assert html_text._placed(nodes) == want


def test_vectors_of_extreme_size_take_part(spark):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(60, 4))
    sizes = [1.0, 1e-170, 1e170, 5e-160]
    rows = [(k, (base[k] * sizes[k % 4]).tolist()) for k in range(60)] + [(100, [0.0] * 4), (101, [1.0, float("inf"), 0.0, 0.0]), (102, [float("nan")] * 4), (103, None), (104, [1.0, None, 2.0, 3.0]), (105, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(vector_search.search(df, probe=1.0).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    assert set(got) == {0, 50}
    for q, found in got.items():
        cos = unit @ unit[q]
        order = [k for k in np.argsort(-cos, kind="stable") if k != q][:5]
        assert [v for v, _ in found] == order and np.allclose([s for _, s in found], cos[order])
