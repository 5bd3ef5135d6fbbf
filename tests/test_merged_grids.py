"""Merged cells against a literal loop over random grids, and grids typed by hand."""
import random
from decimal import Decimal

from foliospark.operators import merged_grids as M

CELLS = "id int, pos int, row int, col int, row_span int, col_span int, text string, column_header boolean, row_section boolean, box array<double>"
GRIDS, ROLES = "id int, num_rows int, num_cols int, family string", "id int, col int, role string"
TEXTS = {"": None, "Oil": None, "Total": None, "Sales  Tax": None, "Totals of it": None, "Taxi ride": None, "a b c d e total": None, "3": 3, "$2.50": Decimal("2.5"), "(1.00)": -1, "Balance due": None, "Tip-top": None, "Grand total": None}


def made(seed):
    r = random.Random(seed)
    cells, pos = [], 0
    for row in range(r.randrange(1, 7)):
        for col in range(4):
            if r.random() < 0.8:
                for _ in range(r.choice((1, 1, 2))):
                    box = None if r.random() < 0.5 else [float(col), float(row), col + 1.0, row + 1.0]
                    cells.append((seed, pos, row, col, r.choice((1, 1, 1, 2, 0, None)), r.choice((1, 1, 1, 2, 3)), r.choice(list(TEXTS)), r.random() < (0.5 if row < 2 else 0.05), r.random() < 0.1, box))
                    pos += 1
    cells += [(seed, pos, -1, 0, 1, 1, "x", False, False, None)]
    roles = [(seed, c, role) for c, role in enumerate(r.sample(["description", "quantity", "amount", "unit_price", "code", "ignored"], 4)) if r.random() < 0.9]
    return cells, (seed, r.choice((None, 3, 9)), r.choice((None, 4)), r.choice(("invoice", "receipt", "retail_order", None))), roles


def loop(cells, grid, roles):
    """(header, labels, rows by number), written out."""
    own = {}
    for c in sorted(cells, key=lambda c: c[1]):
        if c[2] >= 0:
            own.setdefault((c[2], c[3]), (max(c[4] or 1, 1), max(c[5] or 1, 1), " ".join((c[6] or "").split()), c[7], c[8], c[9]))
    rows = grid[1] or max(k[0] + v[0] for k, v in own.items())
    cols = grid[2] or max(k[1] + v[1] for k, v in own.items())
    at = {}
    for (row, col), v in sorted(own.items()):
        for a in range(row, row + v[0]):
            for b in range(col, col + v[1]):
                at.setdefault((a, b), v)
    at = {k: v for k, v in at.items() if k[0] < rows and k[1] < cols}
    value = {" ".join(k.split()): v for k, v in TEXTS.items()}
    if any(v[3] for v in own.values()):
        head = 0
        while head < rows and any(at[head, c][3] for c in range(cols) if (head, c) in at):
            head += 1
        head = max(head, 1)
    else:
        head = 0 if any(value[at[0, c][2]] is not None for c in range(1, cols) if (0, c) in at) else 1
    labels = [" / ".join(dict.fromkeys(at[a, c][2] for a in range(head) if (a, c) in at and at[a, c][2])) for c in range(cols)]
    role, out = {c: x for _, c, x in roles if x in M.FIELDS}, {}
    import re

    for a in range(head, rows):
        line = {c: at[a, c] for c in range(cols) if (a, c) in at}
        if all(not v[2] or v[4] for v in line.values()):
            continue
        names = sorted(c for c in role if role[c] == "description") or [0]
        label = next((line[c][2] for c in names if c in line and line[c][2]), "")
        number = {c: value[v[2]] for c, v in line.items() if value[v[2]] is not None}
        hit = lambda p: re.search(rf"(?<![a-z0-9-]){re.escape(p)}(?![a-z0-9-])", label.casefold())  # noqa: E731, B023
        if label and len(label.split()) <= 5 and not any(role.get(c) == "quantity" for c in number):
            key = next((k for p, k in M.TOTALS.get(grid[3], ()) if hit(p)), None)
            if key:
                money = [c for c in number if role.get(c) == "amount"] or sorted((c for c in number if role.get(c) in M.MONEY), reverse=True) or sorted(number, reverse=True)
                out[a] = ("total", key, number[money[0]]) if money else ("suppressed", "totals_row_without_amount")
                continue
            if any(hit(p) for p in M.NO_ITEM):
                out[a] = ("suppressed", "unmapped_totals_row")
                continue
        fields = {}
        for c in sorted(role):
            if c in line and line[c][2]:
                x = number.get(c) if role[c] in (*M.MONEY, "quantity") else line[c][2]
                if x is not None:
                    fields.setdefault(M.FIELDS[role[c]], x)
        out[a] = ("item", fields) if fields else ("skipped",)
    boxes = {a: [v[5] for c in range(cols) if (v := at.get((a, c))) and v[5]] for a in out}
    return head, labels, {a: (x, [min(b[0] for b in boxes[a]), min(b[1] for b in boxes[a]), max(b[2] for b in boxes[a]), max(b[3] for b in boxes[a])] if boxes[a] else None) for a, x in out.items()}


def told(r):
    number = lambda k, v: Decimal(v) if k in {M.FIELDS[m] for m in (*M.MONEY, "quantity")} else v
    if r.kind == "total":
        return "total", r.key, r.amount
    return {"suppressed": ("suppressed", r.reason), "skipped": ("skipped",)}.get(r.kind) or ("item", {k: number(k, v) for k, v in r.fields.items()})


def test_random_grids(spark):
    grids = {k: made(k) for k in range(120)}
    grids = {k: v for k, v in grids.items() if any(c[2] >= 0 for c in v[0])}
    cells = spark.createDataFrame([c for v in grids.values() for c in v[0]], CELLS).repartition(3)
    sizes, roles = spark.createDataFrame([v[1] for v in grids.values()], GRIDS), spark.createDataFrame([r for v in grids.values() for r in v[2]], ROLES)
    spread = M.places(cells, sizes).cache()
    head = M.header(spread)
    heads = {r.id: r.header for r in head.collect()}
    labels = {r.id: list(r.labels) for r in M.labels(spread, head).collect()}
    rows = {}
    for r in M.extracted(cells, sizes, roles).collect():
        rows.setdefault(r.id, {})[r.row] = (told(r), r.box)
    for k, v in grids.items():
        want = loop(*v)
        assert (heads[k], labels[k]) == want[:2], k
        assert rows.get(k, {}) == want[2], k
    kinds = {x[0][0] for v in rows.values() for x in v.values()}
    assert kinds == {"item", "total", "suppressed", "skipped"}


def test_service_lines(spark):
    """A header of two rows with a merged title, a band, a line item whose name holds a totals word, and a total."""
    c = lambda pos, row, col, text, over=1, head=False, band=False: (1, pos, row, col, 1, over, text, head, band, None)
    cells = [c(0, 0, 0, "Work", 2, True), c(1, 0, 0, "Work", 2, True), c(2, 0, 2, "Charge", head=True), c(3, 1, 0, "Task", head=True), c(4, 1, 1, "Hours", head=True), c(5, 2, 0, "Labor", 3, band=True),
             c(6, 3, 0, "Total fluid change"), c(7, 3, 1, "2"), c(8, 3, 2, "$80.00"), c(9, 4, 0, "Total"), c(10, 4, 2, "$80.00")]
    roles = [(1, 0, "description"), (1, 1, "quantity"), (1, 2, "amount")]
    got = M.extracted(spark.createDataFrame(cells, CELLS), spark.createDataFrame([(1, None, None, "service_record")], GRIDS), spark.createDataFrame(roles, ROLES)).orderBy("row").collect()
    assert [(r.row, told(r)) for r in got] == [(3, ("item", {"description": "Total fluid change", "quantity": 2, "net_amount": 80})), (4, ("total", "service_record.total", 80))]
