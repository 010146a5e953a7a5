"""Small tables for the tests, and the trend rules in plain Python to check Spark's results against."""

import datetime as dt
import random

READING = (
    "source_id string, site_id string, reading_date date, generation_wh double, consumption_wh double, "
    "self_consumption_wh double, grid_export_wh double, grid_import_wh double"
)


def series(spark, values, site="A", start=dt.date(2024, 1, 1)):
    """Readings of one site from (generation, consumption, self consumption) triples, a day apart."""
    rows = [
        (f"{site}_x", site, start + dt.timedelta(days=i), float(g), float(c), float(a), max(g - a, 0.0) * 1.0, max(c - a, 0.0) * 1.0)
        for i, (g, c, a) in enumerate(values)
    ]
    return spark.createDataFrame(rows, READING)


def random_sites(spark, sites=5, days=60, seed=3, outages=True):
    rng = random.Random(seed)
    rows = []
    for s in range(sites):
        date = dt.date(2023, 12, 1)
        for _ in range(days):
            date += dt.timedelta(days=rng.choice([1, 1, 1, 2, 5]))
            g = 0.0 if outages and rng.random() < 0.15 else round(rng.uniform(1, 90000), 2)
            a = round(g * rng.uniform(0.2, 1.0), 2)
            c = 0.0 if rng.random() < 0.05 else round(a + rng.uniform(0, 50000), 2)
            rows.append((f"S{s}_{date.year}", f"S{s}", date, g, c, a, g - a, max(c - a, 0.0)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, READING)


def trend(history, current):
    """(label, speed, change) of one series."""
    if len(history) < 2:
        return "insuficiente", 0.0, None
    steps = [(b - a) / a for a, b in zip(history, history[1:]) if a > 0]
    if not steps:
        return "estable", 0.0, None
    mean = sum(steps) / len(steps)
    label = "aumentando" if mean > 0.05 else "disminuyendo" if mean < -0.05 else "estable"
    last = history[-1]
    return label, abs(mean), (current - last) / max(last, 1) if last > 0 else 0.0


def expected_trends(rows):
    """Per (site, date): history size, the three trends, whether degrading, and the risk score."""
    out, by_site = {}, {}
    for row in sorted(rows, key=lambda r: (r.site_id, r.reading_date)):
        past = by_site.setdefault(row.site_id, [])
        last7 = past[-7:]
        g, c, a = row.generation_wh, row.consumption_wh, row.self_consumption_wh
        trends = (
            trend([h[0] for h in last7], g),
            trend([h[1] for h in last7], c),
            trend([h[2] / max(h[0], 1) for h in last7], a / max(g, 1)),
        )
        y = [h[2] / h[0] for h in last7 if h[0] > 0]
        degrading = False
        if len(y) >= 5:
            mid = (len(y) - 1) / 2
            slope = sum((i - mid) * v for i, v in enumerate(y)) / sum((i - mid) ** 2 for i in range(len(y)))
            degrading = slope < -0.01
        tenths = 0
        if len(last7) >= 3:
            tenths += 3 * (trends[1][0] == "aumentando" and trends[1][1] > 0.15)
            tenths += 4 * (trends[0][0] == "disminuyendo" and trends[0][1] > 0.1)
            tenths += 3 * (trends[2][0] == "disminuyendo" and trends[2][1] > 0.1)
            tenths += 5 * degrading
        out[(row.site_id, row.reading_date)] = (len(last7), *trends, tenths)
        past.append((g, c, a))
    return out
