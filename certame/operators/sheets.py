"""Answer sheets from photographs: markers, rectified fill of bubbles, decisions, summary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certame import fixed
from certame.functions.numbers import decision

FILLS = "id string, total_questoes int, fills array<array<double>>, erro string"


def decode(content: bytes) -> np.ndarray:
    """A grey image from binary PGM or PPM, or whatever Pillow reads where it is installed; ValueError otherwise."""
    if content[:2] in (b"P5", b"P6"):
        head, at = [], 2
        while len(head) < 3:
            while content[at : at + 1].isspace():
                at += 1
            end = at
            while end < len(content) and not content[end : end + 1].isspace():
                end += 1
            head.append(int(content[at:end]))
            at = end
        deep = 3 if content[:2] == b"P6" else 1
        pixels = np.frombuffer(content, np.uint8, head[0] * head[1] * deep, at + 1).reshape(head[1], head[0], deep)
        return pixels @ np.array([0.299, 0.587, 0.114]) if deep == 3 else pixels[:, :, 0].astype(float)
    try:
        import io

        from PIL import Image
    except ImportError as e:
        raise ValueError("no decoder for this image") from e
    try:
        return np.asarray(Image.open(io.BytesIO(content)).convert("L"), dtype=float)
    except Exception as e:
        raise ValueError("not an image") from e


def _gaussian(size: int) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def _smooth(img: np.ndarray, size: int) -> np.ndarray:
    kernel, pad = _gaussian(size), size // 2
    wide = np.pad(img, pad, mode="edge")
    rows = sum(w * wide[i : i + img.shape[0]] for i, w in enumerate(kernel))
    return sum(w * rows[:, i : i + img.shape[1]] for i, w in enumerate(kernel))


def binarize(img: np.ndarray) -> np.ndarray:
    """V1: 255 where a pixel is darker than its surroundings by the offset, else 0."""
    soft = _smooth(img, fixed.BLUR)
    return np.where(soft <= _smooth(soft, fixed.THRESHOLD_BLOCK) - fixed.THRESHOLD_OFFSET, 255, 0).astype(np.uint8)


def _regions(mask: np.ndarray) -> list[np.ndarray]:
    """Pixels (x, y) of the 8-connected regions, by labels that sink to their neighbourhood's least."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        wide = np.pad(np.where(labels > 0, labels, big), 1, constant_values=big)
        least = np.minimum.reduce([wide[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)])
        # follow what the least neighbour has found itself
        flat = np.append(0, labels.ravel())
        new = np.where(labels > 0, least, 0)
        new = np.where(new > 0, np.minimum(new, flat[np.minimum(new, mask.size)]), 0)
        if (new == labels).all():
            break
        labels = new
    y, x = np.nonzero(labels)
    which = labels[y, x]
    order = np.argsort(which, kind="stable")
    cuts = np.flatnonzero(np.diff(which[order])) + 1
    return np.split(np.stack([x, y], axis=1)[order], cuts) if len(order) else []


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, in turn."""

    def half(own: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for p in own:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    own = sorted(set(map(tuple, points.tolist())))
    return np.array(half(own) + half(own[::-1]) or own, dtype=float)


def corners(outline: np.ndarray, share: float = fixed.MARKER_SLACK) -> int:
    """How many corners are left of an outline if none that is dropped lies further off than `share` of its length."""
    n = len(outline)
    if n < 3:
        return n
    slack = share * np.linalg.norm(outline - np.roll(outline, -1, axis=0), axis=1).sum()

    def between(i: int, j: int) -> int:
        own = outline[np.arange(i + 1, j) % n]
        if not len(own):
            return 0
        a, b = outline[i % n], outline[j % n]
        d = b - a
        off = np.abs(d[0] * (own[:, 1] - a[1]) - d[1] * (own[:, 0] - a[0])) / np.linalg.norm(d) if d.any() else np.linalg.norm(own - a, axis=1)
        k = int(off.argmax())
        return 0 if off[k] <= slack else 1 + between(i, i + 1 + k) + between(i + 1 + k, j)

    far = int(np.linalg.norm(outline - outline[0], axis=1).argmax())
    return 2 + between(0, far) + between(far, n)


def markers(binary: np.ndarray) -> np.ndarray | None:
    """V2: the centre of each quarter's marker: a region whose outline has a fitting area, a squarish box and three to six corners, nearest to the quarter's outer middle; None without all four."""
    h, w = binary.shape
    least, most = (w * s * h * s for s in fixed.MARKER_SIDES)
    centres = []
    for points in _regions(binary > 0):
        width, height = points.max(axis=0) - points.min(axis=0) + 1
        if width * height < least or not fixed.MARKER_ASPECT[0] < width / height < fixed.MARKER_ASPECT[1]:
            continue
        outline = hull(points)
        x, y = outline.T
        area = abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2
        if least <= area <= most and 3 <= corners(outline) <= 6:
            centres.append(points.min(axis=0) + np.array([width, height]) // 2)
    if not centres:
        return None
    cx, cy = np.array(centres, dtype=float).T
    found = []
    for top in (True, False):
        for left in (True, False):
            inside = ((cx <= w // 2) if left else (cx >= w // 2)) & ((cy <= h // 2) if top else (cy >= h // 2))
            if not inside.any():
                return None
            far = (cx - w * (1 if left else 7) / 8) ** 2 + (cy - h * (1 if top else 7) / 8) ** 2
            k = np.flatnonzero(inside)[np.argmin(far[inside])]
            found.append((cx[k], cy[k]))
    return np.array(found)


def ordered(points: np.ndarray) -> np.ndarray:
    """V3: top left, top right, bottom left, bottom right."""
    total, lean = points.sum(axis=1), points[:, 1] - points[:, 0]
    return points[[total.argmin(), lean.argmin(), lean.argmax(), total.argmax()]]


def rectify(img: np.ndarray, points: np.ndarray) -> np.ndarray:
    """V4: the sheet between the markers, on a raster of fixed size."""
    w, h = fixed.SHEET_WIDTH, fixed.SHEET_HEIGHT
    to = np.array([[0, 0], [w, 0], [0, h], [w, h]], dtype=float)
    rows, right = [], []
    for (x, y), (u, v) in zip(to, ordered(points), strict=True):  # from the raster to the photograph
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    try:
        m = np.append(np.linalg.solve(np.array(rows), np.array(right)), 1).reshape(3, 3)
    except np.linalg.LinAlgError as e:
        raise ValueError("markers do not span a sheet") from e
    yy, xx = np.mgrid[0:h, 0:w]
    u, v, s = (m[k, 0] * xx + m[k, 1] * yy + m[k, 2] for k in range(3))
    u, v = np.clip(u / s, 0, img.shape[1] - 1.001), np.clip(v / s, 0, img.shape[0] - 1.001)
    i, j = v.astype(int), u.astype(int)
    a, b = v - i, u - j
    return img[i, j] * (1 - a) * (1 - b) + img[i + 1, j] * a * (1 - b) + img[i, j + 1] * (1 - a) * b + img[i + 1, j + 1] * a * b


def bubble_centres(questions: int) -> np.ndarray:
    """centres as (question, option, x and y)."""
    left, top = int(fixed.SHEET_MARGIN * fixed.SHEET_WIDTH), int(fixed.SHEET_HEADER * fixed.SHEET_HEIGHT)
    cell = (fixed.SHEET_WIDTH - 2 * left) // fixed.PER_ROW
    height = (fixed.SHEET_HEIGHT - top - fixed.SHEET_FOOTER) // max(-(-questions // fixed.PER_ROW), 1)
    q, o = np.mgrid[0:questions, 0:5]
    x = left + q % fixed.PER_ROW * cell + cell // 2 - (5 * fixed.BUBBLE + 4 * fixed.BUBBLE_GAP) // 2 + o * (fixed.BUBBLE + fixed.BUBBLE_GAP) + fixed.BUBBLE // 2
    return np.stack([x, top + q // fixed.PER_ROW * height + height // 2], axis=2)


def fill(img: np.ndarray, x: int, y: int, radius: int = fixed.BUBBLE_RADIUS) -> float:
    """V5: darkness of the disc around a point, 0 (white) to 1 (black)."""
    dy, dx = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    inside = (dx**2 + dy**2 <= radius**2) & (y + dy >= 0) & (y + dy < img.shape[0]) & (x + dx >= 0) & (x + dx < img.shape[1])
    pixels = img[(y + dy)[inside], (x + dx)[inside]]
    return float(1 - pixels.mean() / 255) if pixels.size else 0.0


def read_sheet(content: bytes, questions: int) -> tuple[list[list[float]], str | None]:
    """Fill of every bubble, or what went wrong."""
    try:
        img = decode(content)
    except ValueError:
        return [], "imagem ilegível"
    points = markers(binarize(img))
    if points is None:
        return [], "marcadores de canto não encontrados"
    try:
        flat = rectify(img, points)
    except ValueError:
        return [], "perspectiva inválida"
    return [[fill(flat, x, y) for x, y in row] for row in bubble_centres(questions).tolist()], None


# The types that are taken, and how their files begin (in hexadecimal digits).
TYPES = {"image/jpeg": "^FFD8FF", "image/png": "^89504E470D0A1A0A", "image/webp": "^52494646.{8}57454250", "image/x-portable-graymap": "^5035"}


def content_type(content: Column) -> Column:
    """The type of an image by its first bytes; null for any other file."""
    head = F.hex(F.substring(content, 1, 12))
    return F.coalesce(*[F.when(head.rlike(begins), kind) for kind, begins in TYPES.items()])


def input_error(size: Column, questions: Column, kind: Column | None = None) -> Column:
    """Why a photograph is not read at all; null if it is. kind is the type that the upload declares, where it does."""
    wrong = F.lit(False) if kind is None else ~F.coalesce(kind.isin(*TYPES), F.lit(False))
    return F.when(wrong, "tipo de arquivo não suportado").when(size < 1000, "imagem muito pequena").when(~F.coalesce(questions.between(1, 180), F.lit(False)), "número de questões inválido")


def bubble_fills(photos: DataFrame) -> DataFrame:
    """Fills of photos (id, content, total_questoes, maybe content_type), a row each; erro instead where a photo can't be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [read_sheet(c, int(n)) if e is None else ([], e) for c, n, e in zip(f["content"], f["total_questoes"], f["erro"], strict=True)]
            yield pd.DataFrame({"id": f["id"], "total_questoes": f["total_questoes"], "fills": [x[0] for x in got], "erro": [x[1] for x in got]})

    checked = photos.select(F.col("id").cast("string"), "content", F.coalesce(F.col("total_questoes").cast("int"), F.lit(0)).alias("total_questoes"), input_error(F.length("content"), F.col("total_questoes"), F.col("content_type") if "content_type" in photos.columns else None).alias("erro"))
    return checked.mapInPandas(run, FILLS)


def summary(fills: DataFrame) -> DataFrame:
    """Answers, confidences and counts of each sheet, as column functions."""
    d = F.transform("fills", decision)
    letters, sure = F.transform(d, lambda x: x["letra"]), F.transform(d, lambda x: F.bround(x["confianca"], 3))
    marked = F.size(F.filter(letters, lambda x: x.isNotNull()))
    doubtful = F.size(F.filter(F.arrays_zip(letters.alias("l"), sure.alias("c")), lambda z: z["l"].isNotNull() & (z["c"] < 0.8)))
    mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, x: a + x) / F.size(sure)).otherwise(0.0)
    ok = F.col("erro").isNull()
    return fills.select(
        "id", ok.alias("sucesso"), letters.alias("respostas"), "total_questoes", marked.alias("n_marcadas"), doubtful.alias("n_ambiguas"), sure.alias("confiancas"), F.bround(mean, 3).alias("conf_media"), "erro",
    )


def correct_sheets(photos: DataFrame) -> DataFrame:
    """V7, V8: photos to results."""
    return summary(bubble_fills(photos))
