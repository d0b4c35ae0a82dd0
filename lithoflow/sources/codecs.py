"""Raster formats as bytes: ESRI ASCII, Surfer 7 and GeoTIFF, in both directions.

Arrays are north-up, ``(nrows, ncols)``. NaN stands for missing in arrays only; the
DataFrame readers turn it into NULL.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from lithoflow.operators.grid import GridMeta


# ---- ESRI ASCII
def _is_number(s: str) -> bool:
    try:
        float(s)
    except ValueError:
        return False
    return True


def read_esri(data: bytes) -> tuple[np.ndarray, GridMeta]:
    """Header lines are ``key number`` in any case; a centre reference is moved to the corner; nodata is missing."""
    lines = data.decode("utf-8", "replace").splitlines()
    head: dict[str, float] = {}
    k = 0
    for k, line in enumerate(lines):
        parts = line.split()
        if len(parts) != 2 or _is_number(parts[0]) or not _is_number(parts[1]):
            break
        head[parts[0].lower()] = float(parts[1])
    else:
        k = len(lines)
    size = head.get("cellsize", head.get("dx"))
    if size is None or "ncols" not in head or "nrows" not in head:
        raise ValueError("not an ESRI ASCII grid: ncols, nrows or cellsize is missing")
    dy = head.get("dy", size)
    x0 = head["xllcorner"] if "xllcorner" in head else head["xllcenter"] - size / 2
    y0 = head["yllcorner"] if "yllcorner" in head else head["yllcenter"] - dy / 2
    nodata = head.get("nodata_value")
    z = np.array(" ".join(lines[k:]).split(), float)
    shape = (int(head["nrows"]), int(head["ncols"]))
    if z.size != shape[0] * shape[1]:
        raise ValueError(f"ESRI ASCII grid holds {z.size} values for {shape[0]} x {shape[1]} cells")
    z = z.reshape(shape)
    if nodata is not None:
        z[z == nodata] = np.nan
    return z, GridMeta.of({"ncols": shape[1], "nrows": shape[0], "dx": size, "dy": dy, "xllcorner": x0, "yllcorner": y0, "nodata": nodata})


def write_esri(z: np.ndarray, meta: GridMeta, nodata: float = -9999.0) -> bytes:
    head = f"ncols {meta.ncols}\nnrows {meta.nrows}\nxllcorner {meta.xllcorner!r}\nyllcorner {meta.yllcorner!r}\ncellsize {meta.dx!r}\nNODATA_value {nodata!r}\n"
    rows = (" ".join(repr(float(v)) for v in row) for row in np.where(np.isnan(z), nodata, z))
    return (head + "\n".join(rows) + "\n").encode()


# ---- Surfer 7
def read_surfer7(data: bytes, crs=None) -> tuple[np.ndarray, GridMeta]:
    """Sections ``GRID`` and ``DATA``; south-up nodes become north-up cells, blanks are missing."""
    if data[:4] != b"DSRB":
        raise ValueError("not a Surfer 7 grid")
    pos, info, z = 0, None, None
    while pos + 8 <= len(data):
        tag, size = data[pos : pos + 4], struct.unpack_from("<i", data, pos + 4)[0]
        body = pos + 8
        if tag == b"GRID":
            rows, cols = struct.unpack_from("<2i", data, body)
            info = (rows, cols, *struct.unpack_from("<8d", data, body + 8))  # xll yll dx dy zmin zmax rotation blank
        elif tag == b"DATA":
            z = np.frombuffer(data, "<f8", size // 8, body).copy()
        pos = body + size
    if info is None or z is None:
        raise ValueError("a Surfer 7 grid needs the sections GRID and DATA")
    rows, cols, x0, y0, dx, dy, _, _, _, blank = info
    z = z.reshape(rows, cols)
    z[z >= blank] = np.nan
    return z[::-1].copy(), GridMeta.of({"ncols": cols, "nrows": rows, "dx": dx, "dy": dy, "xllcorner": x0 - dx / 2, "yllcorner": y0 - dy / 2, "crs": crs})


def write_surfer7(z: np.ndarray, meta: GridMeta, blank: float = 1.70141e38) -> bytes:
    ok = z[np.isfinite(z)]
    lo, hi = (ok.min(), ok.max()) if ok.size else (0.0, 0.0)
    grid = struct.pack("<2i8d", meta.nrows, meta.ncols, meta.xllcorner + meta.dx / 2, meta.yllcorner + meta.dy / 2, meta.dx, meta.dy, lo, hi, 0.0, blank)
    body = np.where(np.isnan(z), blank, z)[::-1].astype("<f8").tobytes()
    return b"DSRB" + struct.pack("<2i", 4, 1) + b"GRID" + struct.pack("<i", len(grid)) + grid + b"DATA" + struct.pack("<i", len(body)) + body


# ---- GeoTIFF. TIFF tag numbers and sizes of field types.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTO, _STRIPS, _SAMPLES, _ROWS, _COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
_PLANAR, _PREDICTOR, _TILE_W, _TILE_H, _TILES, _TILE_COUNTS, _FORMAT = 284, 317, 322, 323, 324, 325, 339
_SCALE, _TIEPOINT, _MATRIX, _KEYS, _DOUBLES, _ASCII, _NODATA = 33550, 33922, 34264, 34735, 34736, 34737, 42113
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}


def lzw_decode(data: bytes) -> bytes:
    """TIFF flavour: most significant bit first, codes grow one early."""
    out = bytearray()
    fresh = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, acc, bits, prev = list(fresh), 9, 0, 0, None
    for byte in data:
        acc = (acc << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, prev = list(fresh), 9, None
            continue
        if prev is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else prev + prev[:1]
            table.append(prev + entry[:1])
        out += entry
        prev = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    table = {bytes([k]): k for k in range(256)}
    width, acc, bits, nxt, out = 9, 0, 0, 258, bytearray()

    def put(code: int) -> None:
        nonlocal acc, bits
        acc = (acc << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits)
            acc &= (1 << bits) - 1

    put(256)
    w = b""
    for k in data:
        c = w + bytes([k])
        if c in table:
            w = c
            continue
        put(table[w])
        table[c] = nxt
        nxt += 1
        if nxt == (1 << width) and width < 12:
            width += 1
        if nxt == 4094:
            put(256)
            table, width, nxt = {bytes([k]): k for k in range(256)}, 9, 258
        w = bytes([k])
    if w:
        put(table[w])
        nxt += 1
        if nxt == (1 << width) and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((acc << (8 - bits)) & 0xFF)
    return bytes(out)


def read_geotiff(data: bytes) -> tuple[np.ndarray, GridMeta]:
    """First band, values as stored (nodata too); strips or tiles, plain, LZW or deflate, predictors 1 to 3."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    pos = struct.unpack_from(order + "I", data, 4)[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack_from(order + "H", data, pos)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", data, pos + 2 + 12 * k)
        if kind not in _TYPES:
            continue
        code, size = _TYPES[kind]
        at = pos + 10 + 12 * k
        if size * count > 4:
            at = struct.unpack_from(order + "I", data, at)[0]
        tags[tag] = (data[at : at + count].split(b"\0")[0].decode("latin-1"),) if kind == 2 else struct.unpack_from(f"{order}{count}{code}", data, at)
    w, h = tags[_WIDTH][0], tags[_HEIGHT][0]
    samples, planar = tags.get(_SAMPLES, (1,))[0], tags.get(_PLANAR, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(_FORMAT, (1,))[0]]
    width = tags.get(_BITS, (8,))[0] // 8
    dtype = np.dtype(f"{order}{kind}{width}")
    comp, pred = tags.get(_COMPRESSION, (1,))[0], tags.get(_PREDICTOR, (1,))[0]
    unpack = {1: bytes, 5: lzw_decode, 8: zlib.decompress, 32946: zlib.decompress}.get(comp)
    if unpack is None:
        raise ValueError(f"TIFF compression {comp} is not supported")
    per = samples if planar == 1 else 1

    def block(offset: int, count: int, rows: int, cols: int) -> np.ndarray:
        raw = unpack(data[offset : offset + count])
        n = rows * cols * per * width
        raw = raw[:n] + b"\0" * max(0, n - len(raw))
        if pred == 3:
            b = np.frombuffer(raw, np.uint8).reshape(rows, cols * per * width)
            b = np.cumsum(b.reshape(rows, -1, per), axis=1, dtype=np.uint8).reshape(rows, width, cols * per)
            return np.ascontiguousarray(b.transpose(0, 2, 1)).view(f">{kind}{width}").reshape(rows, cols, per)
        a = np.frombuffer(raw, dtype).reshape(rows, cols, per)
        return np.cumsum(a, axis=1, dtype=dtype.newbyteorder("=")) if pred == 2 else a

    out = np.empty((h, w), float)
    if _TILES in tags:
        tw, th = tags[_TILE_W][0], tags[_TILE_H][0]
        across = -(-w // tw)
        for k in range(across * -(-h // th)):
            y, x = divmod(k, across)
            t = block(tags[_TILES][k], tags[_TILE_COUNTS][k], th, tw)[..., 0]
            out[y * th : (y + 1) * th, x * tw : (x + 1) * tw] = t[: h - y * th, : w - x * tw]
    else:
        rows = min(tags.get(_ROWS, (h,))[0], h)
        for k in range(-(-h // rows)):
            n = min(rows, h - k * rows)
            out[k * rows : k * rows + n] = block(tags[_STRIPS][k], tags[_COUNTS][k], n, w)[..., 0]
    if _SCALE in tags:
        sx, sy = tags[_SCALE][:2]
        i, j, _, x, y, _ = tags[_TIEPOINT][:6]
        x0, y1 = x - i * sx, y + j * sy
        if _pixel_is_point(tags):
            x0, y1 = x0 - sx / 2, y1 + sy / 2
    elif _MATRIX in tags:
        m = tags[_MATRIX]
        sx, sy, x0, y1 = m[0], -m[5], m[3], m[7]
    else:
        sx, sy, x0, y1 = 1.0, 1.0, 0.0, float(h)
    nodata = None
    if _NODATA in tags:
        nodata = float(tags[_NODATA][0])
    return out, GridMeta.of({"ncols": w, "nrows": h, "dx": sx, "dy": sy, "xllcorner": x0, "yllcorner": y1 - h * sy, "nodata": nodata, "crs": _epsg(tags)})


def _keys(tags: dict) -> dict[int, int]:
    k = tags.get(_KEYS, ())
    return {k[n]: k[n + 3] for n in range(4, len(k) - 3, 4) if k[n + 1] == 0}


def _pixel_is_point(tags: dict) -> bool:
    return _keys(tags).get(1025) == 2


def _epsg(tags: dict) -> str | None:
    k = _keys(tags)
    code = k.get(3072) or k.get(2048)
    return f"EPSG:{code}" if code and code != 32767 else None


def write_geotiff(z: np.ndarray, meta: GridMeta, nodata: float | None = None, compression: str = "lzw", dtype: str = "<f4") -> bytes:
    """One band in strips of about 64 kB."""
    z = np.asarray(z, float)
    if z.shape != (meta.nrows, meta.ncols):
        raise ValueError(f"array {z.shape} does not fit a grid of {meta.nrows} x {meta.ncols}")
    if nodata is not None:
        z = np.where(np.isnan(z), nodata, z)
    body = z.astype(dtype)
    rows = max(1, 65536 // max(1, meta.ncols * body.itemsize))
    pack = {"none": bytes, "lzw": lzw_encode, "deflate": zlib.compress}[compression]
    strips = [pack(body[k : k + rows].tobytes()) for k in range(0, meta.nrows, rows)]
    epsg = str(meta.crs or "").upper().removeprefix("EPSG:")
    keys = [1, 1, 0, 2 if epsg.isdigit() else 1, 1025, 0, 1, 1]
    if epsg.isdigit():
        geographic = 4000 <= int(epsg) < 5000
        keys = [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, int(epsg)]
    kind = {"f": 3, "i": 2, "u": 1}[body.dtype.kind]
    fields = [
        (_WIDTH, 4, [meta.ncols]), (_HEIGHT, 4, [meta.nrows]), (_BITS, 3, [8 * body.itemsize]), (_COMPRESSION, 3, [{"none": 1, "lzw": 5, "deflate": 8}[compression]]),
        (_PHOTO, 3, [1]), (_STRIPS, 4, [0] * len(strips)), (_SAMPLES, 3, [1]), (_ROWS, 4, [rows]), (_COUNTS, 4, [len(s) for s in strips]), (_PLANAR, 3, [1]),
        (_FORMAT, 3, [kind]), (_SCALE, 12, [meta.dx, meta.dy, 0.0]), (_TIEPOINT, 12, [0.0, 0.0, 0.0, meta.xllcorner, meta.yllcorner + meta.nrows * meta.dy, 0.0]), (_KEYS, 3, keys),
    ]
    if nodata is not None:
        fields.append((_NODATA, 2, list((repr(float(nodata)) + "\0").encode())))
    start = 8 + 2 + 12 * len(fields) + 4
    extra, entries, late = b"", [], None
    for tag, typ, vals in fields:
        code, size = _TYPES[typ]
        raw = bytes(vals) if typ == 2 else struct.pack(f"<{len(vals)}{code}", *vals)
        if tag == _STRIPS:
            late = (len(entries), len(extra), len(raw))
        if len(raw) > 4:
            entries.append(struct.pack("<HHII", tag, typ, len(vals), start + len(extra)))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            entries.append(struct.pack("<HHI", tag, typ, len(vals)) + raw.ljust(4, b"\0"))
    at = start + len(extra) + np.concatenate([[0], np.cumsum([len(s) for s in strips])[:-1]])
    offsets = struct.pack(f"<{len(strips)}I", *map(int, at))
    if late[2] > 4:
        extra = extra[: late[1]] + offsets + extra[late[1] + late[2] :]
    else:
        entries[late[0]] = entries[late[0]][:8] + offsets
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + b"".join(entries) + b"\0\0\0\0" + extra + b"".join(strips)


#: File extension to decoder.
DECODERS = {".grd": read_surfer7, ".tif": read_geotiff, ".tiff": read_geotiff, ".asc": read_esri, ".txt": read_esri}


def decoder_for(path: str):
    ext = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ext not in DECODERS:
        raise ValueError(f"unknown grid format {path!r}; known: {sorted(DECODERS)}")
    return DECODERS[ext]
