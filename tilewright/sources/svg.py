"""Tiles as SVG drawings: one tile or a grid of them, with a colour for each layer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from xml.sax.saxutils import quoteattr

from tilewright.schema import EXTENT, LAYERS
from tilewright.sources.mvt import LINE, POINT, Feature


def colour(layer: str) -> str:
    """A fixed hue for each layer, spread over the circle by its id."""
    at = next((x.id for x in LAYERS if x.name == layer), len(LAYERS))
    return f"hsl({at * 137 % 360},60%,50%)"


def draw(tiles: dict[tuple[int, int], dict[str, list[Feature]]], layers: Iterable[str] | None = None, size: int = 256) -> str:
    """An SVG of decoded tiles by (column, row); layers in archive order, only those asked for."""
    wanted = set(layers) if layers is not None else None
    columns, rows = (1 + max((k[i] for k in tiles), default=0) for i in (0, 1))
    order = {x.name: x.id for x in LAYERS}
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{columns * size}" height="{rows * size}" viewBox="0 0 {columns * EXTENT} {rows * EXTENT}">']
    for (column, row), content in sorted(tiles.items()):
        out.append(f'<g transform="translate({column * EXTENT},{row * EXTENT})">')
        for layer in sorted(content, key=lambda n: (order.get(n, 99), n)):
            if wanted is not None and layer not in wanted:
                continue
            out.append(f"<g id={quoteattr(layer)} stroke={quoteattr(colour(layer))} stroke-width='8'>")
            for f in content[layer]:
                if f.kind == POINT:
                    out += [f'<circle cx="{x}" cy="{y}" r="24"/>' for part in f.parts for x, y in part]
                    continue
                path = "".join("M" + "L".join(f"{x} {y}" for x, y in part) + ("" if f.kind == LINE else "Z") for part in f.parts)
                fill = "none" if f.kind == LINE else colour(layer)
                out.append(f'<path d="{path}" fill="{fill}" fill-rule="evenodd"/>')
            out.append("</g>")
        out.append("</g>")
    return "".join([*out, "</svg>"])


def render(tiles: dict[tuple[int, int], dict[str, list[Feature]]], style: dict[str, dict[str, object]], told: dict | None = None, size: int = 256) -> tuple[str, dict]:
    """A picture of the layers that a style names, with its attributes, and a manifest: ``told``, features by layer, digest."""
    columns, rows = (1 + max((k[i] for k in tiles), default=0) for i in (0, 1))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{columns * size}" height="{rows * size}" viewBox="0 0 {columns * EXTENT} {rows * EXTENT}">']
    counts: dict[str, int] = {}
    for (column, row), content in sorted(tiles.items()):
        out.append(f'<g transform="translate({column * EXTENT},{row * EXTENT})">')
        for layer, paint in style.items():  # in the style's order
            features = content.get(layer, [])
            counts[layer] = counts.get(layer, 0) + len(features)
            paint = {"fill": "none"} | paint
            out.append(f"<g id={quoteattr(layer)} " + " ".join(f"{k}={quoteattr(str(v))}" for k, v in paint.items()) + ">")
            for f in features:
                out += [f'<circle cx="{x}" cy="{y}" r="24"/>' for part in f.parts for x, y in part] if f.kind == POINT else [outline(f)]
            out.append("</g>")
        out.append("</g>")
    picture = "".join([*out, "</svg>"])
    return picture, (told or {}) | {"layers": counts, "tiles": len(tiles), "digest": hashlib.sha256(picture.encode()).hexdigest()}


def outline(f: Feature) -> str:
    path = "".join("M" + "L".join(f"{x} {y}" for x, y in part) + ("" if f.kind == LINE else "Z") for part in f.parts)
    return f'<path d="{path}"' + (' fill="none"' if f.kind == LINE else "") + ' fill-rule="evenodd"/>'
