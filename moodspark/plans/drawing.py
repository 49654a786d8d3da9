"""Charts as SVG text, from rows of small aggregates. No drawing library is needed."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence

Row = Mapping[str, object]
WIDTH, HEIGHT = 640, 360
LEFT, RIGHT, TOP, BOTTOM = 56, 150, 36, 56
INK, FAINT = "#222222", "#dddddd"


def colour(place: int, count: int) -> str:
    """Evenly spaced hues of one lightness."""
    return f"hsl({round(360 * place / max(1, count) + 210) % 360}, 55%, 48%)"


def text(x: float, y: float, words: object, anchor: str = "middle", size: int = 11) -> str:
    return f"<text x='{x:.1f}' y='{y:.1f}' text-anchor='{anchor}' font-size='{size}' fill='{INK}'>{html.escape(str(words))}</text>"


def line(x1: float, y1: float, x2: float, y2: float, stroke: str = INK, width: float = 1) -> str:
    return f"<line x1='{x1:.1f}' y1='{y1:.1f}' x2='{x2:.1f}' y2='{y2:.1f}' stroke='{stroke}' stroke-width='{width}'/>"


def box(x: float, y: float, w: float, h: float, fill: str, hint: str) -> str:
    return f"<rect x='{x:.1f}' y='{y:.1f}' width='{max(w, 0):.1f}' height='{max(h, 0):.1f}' fill='{fill}'><title>{html.escape(hint)}</title></rect>"


def frame(title: str, body: Sequence[str], labels: Sequence[str] = ()) -> str:
    """The whole picture, with a key of ``labels`` at its right."""
    key = []
    for i, label in enumerate(labels):
        key += [box(WIDTH - RIGHT + 14, TOP + 18 * i, 10, 10, colour(i, len(labels)), label), text(WIDTH - RIGHT + 30, TOP + 9 + 18 * i, label, "start")]
    head = f"<svg xmlns='http://www.w3.org/2000/svg' viewBox='0 0 {WIDTH} {HEIGHT}' role='img' font-family='sans-serif'><title>{html.escape(title)}</title>"
    return "".join([head, f"<rect width='{WIDTH}' height='{HEIGHT}' fill='white'/>", text(LEFT, 20, title, "start", 14), *body, *key, "</svg>"])


def known(values: Sequence[object]) -> list[float]:
    return [float(v) for v in values if v is not None]


class Scale:
    """Values to places on the vertical axis."""

    def __init__(self, values: Sequence[object], least: float | None = None, most: float | None = None) -> None:
        found = known(values) or [0.0]
        self.low = min([*found, *([least] if least is not None else [])])
        self.high = max([*found, *([most] if most is not None else [])])
        if self.high == self.low:
            self.high = self.low + 1

    def y(self, value: float) -> float:
        return HEIGHT - BOTTOM - (value - self.low) / (self.high - self.low) * (HEIGHT - TOP - BOTTOM)

    def grid(self) -> list[str]:
        out = []
        for i in range(5):
            value = self.low + (self.high - self.low) * i / 4
            out += [line(LEFT, self.y(value), WIDTH - RIGHT, self.y(value), FAINT), text(LEFT - 6, self.y(value) + 4, f"{value:.2f}", "end")]
        return out


def slots(count: int) -> list[float]:
    """The middles of ``count`` places along the horizontal axis."""
    step = (WIDTH - LEFT - RIGHT) / max(1, count)
    return [LEFT + step * (i + 0.5) for i in range(count)]


def below(xs: Sequence[float], names: Sequence[object]) -> list[str]:
    return [text(x, HEIGHT - BOTTOM + 18, n) for x, n in zip(xs, names, strict=True)]


def lines(rows: Sequence[Row], x: str, ys: Sequence[str], title: str) -> str:
    """One line a measure over the rows in their order; a missing value breaks its line."""
    xs = slots(len(rows))
    body = below(xs, [r[x] for r in rows])
    scale = Scale([r[y] for r in rows for y in ys])
    body = scale.grid() + body
    for k, y in enumerate(ys):
        hue, last = colour(k, len(ys)), None
        for at, r in zip(xs, rows, strict=True):
            if r[y] is None:
                last = None
                continue
            here = (at, scale.y(float(r[y])))
            if last:
                body.append(line(*last, *here, hue, 2))
            body.append(f"<circle cx='{here[0]:.1f}' cy='{here[1]:.1f}' r='3' fill='{hue}'><title>{html.escape(f'{r[x]} {y}: {float(r[y]):.3f}')}</title></circle>")
            last = here
    return frame(title, body, ys)


def stacked(rows: Sequence[Row], x: str, part: str, value: str, title: str, order: Sequence[object], parts: Sequence[str]) -> str:
    """A bar for each label of ``order``, made of its parts' shares from 0 to the greatest total."""
    xs = slots(len(order))
    width = 0.7 * (WIDTH - LEFT - RIGHT) / max(1, len(order))
    given = {(r[x], r[part]): float(r[value] or 0) for r in rows}
    totals = [sum(given.get((label, p), 0.0) for p in parts) for label in order]
    scale = Scale(totals, 0.0)
    body = scale.grid() + below(xs, order)
    for at, label in zip(xs, order, strict=True):
        base = 0.0
        for k, p in enumerate(parts):
            size = given.get((label, p), 0.0)
            if size:
                body.append(box(at - width / 2, scale.y(base + size), width, scale.y(base) - scale.y(base + size), colour(k, len(parts)), f"{label} {p}: {size:.1f}"))
            base += size
    return frame(title, body, parts)


def heatmap(rows: Sequence[Row], y: str, columns: Sequence[str], title: str) -> str:
    """A row for each tag, a cell for each column, darker for greater values."""
    most = max(known([r[c] for r in rows for c in columns]), default=0.0) or 1.0
    left, right = LEFT + 90, WIDTH - 20
    w, h = (right - left) / max(1, len(columns)), (HEIGHT - TOP - BOTTOM) / max(1, len(rows))
    body = [text(left + w * (i + 0.5), HEIGHT - BOTTOM + 18, c) for i, c in enumerate(columns)]
    for j, r in enumerate(rows):
        body.append(text(left - 6, TOP + h * (j + 0.5) + 4, r[y], "end"))
        for i, c in enumerate(columns):
            value = float(r[c] or 0)
            body.append(box(left + w * i, TOP + h * j, w - 1, h - 1, f"hsl(210, 60%, {96 - 60 * value / most:.0f}%)", f"{r[y]} {c}: {value:.1f}"))
    return frame(title, body)


def boxes(rows: Sequence[Row], x: str, title: str) -> str:
    """Box plots of five-number summaries: low, q1, median, q3 and high, the whiskers no longer than the fences."""
    xs = slots(len(rows))
    width = 0.5 * (WIDTH - LEFT - RIGHT) / max(1, len(rows))
    scale = Scale([r[c] for r in rows for c in ("low", "high")])
    body = scale.grid() + below(xs, [r[x] for r in rows])
    for k, (at, r) in enumerate(zip(xs, rows, strict=True)):
        if r["median"] is None:
            continue
        low, high = max(float(r["low"]), float(r["lower_fence"])), min(float(r["high"]), float(r["upper_fence"]))
        body += [line(at, scale.y(low), at, scale.y(high)), line(at - width / 4, scale.y(low), at + width / 4, scale.y(low)), line(at - width / 4, scale.y(high), at + width / 4, scale.y(high))]
        body.append(box(at - width / 2, scale.y(float(r["q3"])), width, scale.y(float(r["q1"])) - scale.y(float(r["q3"])), colour(k, len(rows)), f"{r[x]}: median {float(r['median']):.3f}"))
        body.append(line(at - width / 2, scale.y(float(r["median"])), at + width / 2, scale.y(float(r["median"])), INK, 2))
    return frame(title, body)
