"""Page geometry: tilings, letterboxing, coordinates and token layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.core import let

# The canvas, tile and grid sizes.
CANVAS, TILE, LEAST_TILES, MOST_TILES, GRID, BASE_TOKENS = 1024, 640, 2, 32, 10, 273
DPI, POINTS, PAD = 120, 72, 0.06
WINDOW = 14


def tilings() -> list[tuple[int, int]]:
    """All (columns, rows) of 2 to 32 tiles, fewest tiles first, then fewest columns."""
    return sorted(((i, j) for i in range(1, MOST_TILES + 1) for j in range(1, MOST_TILES + 1) if LEAST_TILES <= i * j <= MOST_TILES), key=lambda t: (t[0] * t[1], t))


def tile_choice(width: Column, height: Column) -> Column:
    """struct(w, h): the tiling whose ratio is nearest to the page's, compared in single precision.

    Of equally near ones the first, unless the page's area is over half that of a later one's tiles.
    """
    options = F.array(*[F.struct(F.lit(i).alias("w"), F.lit(j).alias("h")) for i, j in tilings()])
    start = F.struct(F.lit(1e9).cast("float").alias("d"), F.lit(1).alias("w"), F.lit(1).alias("h"))

    def step(ratio: Column, a: Column, t: Column) -> Column:
        d = F.abs(ratio - (t["w"] / t["h"]).cast("float"))
        better = (d < a["d"]) | ((d == a["d"]) & (width * height > F.lit(0.5 * TILE * TILE) * t["w"] * t["h"]))
        return F.when(better, F.struct(d.alias("d"), t["w"].alias("w"), t["h"].alias("h"))).otherwise(a)

    ratio = (width.cast("float") / height.cast("float")).cast("float")
    return F.aggregate(options, start, lambda a, t: step(ratio, a, t), lambda a: F.struct(a["w"].alias("w"), a["h"].alias("h")))


def tile_tokens(w: Column, h: Column) -> Column:
    return h * GRID * (w * GRID + 1) + BASE_TOKENS


def half_away(x: Column) -> Column:
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def letterbox(width: Column, height: Column) -> Column:
    """struct(w, h, x, y): size and offset of an image of so many pixels, scaled to fit the canvas and centred."""
    scale = F.least(F.lit(float(CANVAS)) / width, F.lit(float(CANVAS)) / height)
    return let(F.struct(half_away(width * scale).alias("w"), half_away(height * scale).alias("h")), lambda n: F.struct(n["w"].alias("w"), n["h"].alias("h"), F.floor((CANVAS - n["w"]) / 2).alias("x"), F.floor((CANVAS - n["h"]) / 2).alias("y")))


def unproject(page_w: Column, page_h: Column, box: list[Column], scale: int = 1000, letterboxed: bool = True) -> list[Column]:
    """A box in ``scale`` parts of the canvas (or of the page, if not letterboxed) as page points, clipped to the page."""
    s = F.lit(float(CANVAS)) / F.greatest(page_w, page_h)
    out = []
    for k, v in enumerate(box):
        size = page_w if k % 2 == 0 else page_h
        at = (v / float(scale) * CANVAS - (CANVAS - size * s) / 2) / s if letterboxed else v / float(scale) * size
        out.append(F.greatest(F.lit(0.0), F.least(size.cast("double"), at)))
    return out


def crop_plan(page_w: Column, page_h: Column, box: list[Column]) -> Column:
    """struct(x0, y0, x1, y1, zoom) of a box in points, padded and clipped; null if less than four points remain."""
    x0, y0, x1, y1 = box
    m = F.greatest(x1 - x0, y1 - y0) * PAD
    grown = F.struct(F.greatest(F.lit(0.0), x0 - m).alias("x0"), F.greatest(F.lit(0.0), y0 - m).alias("y0"), F.least(page_w.cast("double"), x1 + m).alias("x1"), F.least(page_h.cast("double"), y1 + m).alias("y1"))
    return let(grown, lambda r: F.when((r["x1"] - r["x0"] > 4) & (r["y1"] - r["y0"] > 4), F.struct(r["x0"].alias("x0"), r["y0"].alias("y0"), r["x1"].alias("x1"), r["y1"].alias("y1"), (F.lit(float(CANVAS)) / F.greatest(r["x1"] - r["x0"], r["y1"] - r["y0"])).alias("zoom"))))


def base_token(t: Column) -> Column:
    """struct(kind, src) of a base page's token: 16 rows of 16 with a newline each, and a separator."""
    line_end = t % 17 == 16
    return F.when(t == BASE_TOKENS - 1, F.struct(F.lit("separator").alias("kind"), F.lit(None).cast("long").alias("src"))).when(line_end, F.struct(F.lit("newline").alias("kind"), F.lit(None).cast("long").alias("src"))).otherwise(F.struct(F.lit("visual").alias("kind"), (F.floor(t / 17) * 16 + t % 17).cast("long").alias("src")))


def tile_token(t: Column, w: Column, h: Column) -> Column:
    """struct(kind, tile, cell) of a tiled page's token: rows across all tiles with a newline each, then the base page."""
    width = w * GRID + 1
    row, col = F.floor(t / width), t % width
    local = t < h * GRID * width
    kind = F.when(~local, "global").when(col == w * GRID, "newline").otherwise("visual")
    visual = local & (col < w * GRID)
    return F.struct(kind.alias("kind"), F.when(visual, F.floor(row / GRID) * w + F.floor(col / GRID)).cast("long").alias("tile"), F.when(visual, (row % GRID) * GRID + col % GRID).when(~local, t - h * GRID * width).cast("long").alias("cell"))


def window_cell(row: Column, col: Column, grid: Column) -> Column:
    """struct(window, cell): where a cell of a square grid stands among the windows of its zero-padded form, rows first."""
    across = F.ceil(grid / WINDOW)
    return F.struct((F.floor(row / WINDOW) * across + F.floor(col / WINDOW)).cast("long").alias("window"), (row % WINDOW * WINDOW + col % WINDOW).cast("long").alias("cell"))


def grid_cell(window: Column, cell: Column, grid: Column) -> Column:
    """struct(row, col) of a window's cell; null for one of the padding."""
    across = F.ceil(grid / WINDOW)
    row, col = F.floor(window / across) * WINDOW + F.floor(cell / WINDOW), window % across * WINDOW + cell % WINDOW
    return F.when((row < grid) & (col < grid), F.struct(row.cast("long").alias("row"), col.cast("long").alias("col")))
