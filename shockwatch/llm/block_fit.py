"""Fits the weights of ``block_weights`` on generated pages whose blocks are labelled by construction.

    python -m shockwatch.llm.block_fit

A page has an article in one of several shells (plain, named, mixed with names that speak against it, or
wrapped whole in an element that does) and clutter of many kinds around and inside it. A logistic
regression on the features of ``extract`` is fitted by plain gradient steps: weights start at PRIOR by
sign, keep their sign, are pulled back to the prior, and stay within MOST, so no name outweighs all else.
"""

from __future__ import annotations

import math
import random

from . import block_weights as start
from .extract import Page, features

PAGES, STEPS, RATE, PULL, MOST = 1000, 300, 0.5, 0.002, 6.0
PRIOR = {True: 1.5, False: -5.0}
HELD = {"<li>": -0.1}
SHELLS = ["<article>{}</article>", "<main>{}</main>", "<div class='{for_}'>{}</div>", "<article class='{for_} {against}'>{}</article>",
          "<form><div class={for_}>{}</div></form>", "<div class='{for_} {against}'>{}</div>", "<div id=page>{}</div>",
          "<div class='with-{against}'><article>{}</article></div>", "<section class='{against}'><main class={for_}>{}</main></section>"]


def sentence(draw: random.Random, least: int, most: int) -> str:
    said = " ".join("".join(draw.choices("aeioulnrst", k=draw.randint(1, 9))) for _ in range(draw.randint(least, most)))
    return said.capitalize() + draw.choice([".", ".", ".", "!", "?", ""])


def clutter(draw: random.Random) -> str:
    """A block or list that is no part of an article, under one or two names that say so."""
    names = [w for w, x in start.WEIGHTS.items() if x < 0 and w[0] != "<"]
    elements = [w[1:-1] for w, x in start.WEIGHTS.items() if x < -1 and w[0] == "<" and w != "<head>"]
    tag, name = draw.choice([(draw.choice(elements), ""), ("div", draw.choice(names)), (draw.choice(elements), draw.choice(names)),
                             ("ul", draw.choice(names)), ("section", f"{draw.choice(names)} {draw.choice(names)}")])
    kind = draw.random()
    if kind < 0.4:
        inner = "".join(f"<li><a href=/{i}>{sentence(draw, 1, 4)}</a></li>" for i in range(draw.randint(1, 7)))
    elif kind < 0.8:
        part = draw.choice(["p", "p", "p", "blockquote", "pre", "div"])
        inner = "".join(f"<{part}>{sentence(draw, 4, 60)}</{part}>" for _ in range(draw.randint(1, 6)))
    else:
        part = draw.choice(["h1", "h2", "h3", "h4"])
        inner = f"<{part}>{sentence(draw, 1, 6)}</{part}>{sentence(draw, 2, 30)}"
    return f"<{tag} class='{name}'>{inner}</{tag}>"


def made(seed: int) -> tuple[Page, list[bool]]:
    """A page, and which of its blocks belong to the article."""
    draw = random.Random(seed)
    good = [w for w, x in start.WEIGHTS.items() if x > 0 and w[0] != "<"]
    bad = [w for w, x in start.WEIGHTS.items() if x < 0 and w[0] != "<"]
    said = [sentence(draw, 2, 9)] + [sentence(draw, draw.choice([1, 8, 30]), 70) for _ in range(draw.randint(2, 9))]
    tags = ["h1"] + draw.choices(["p", "p", "p", "p", "h2", "h3", "blockquote", "pre", "li"], k=len(said) - 1)
    parts = [f"<{t}>{s}</{t}>" for t, s in zip(tags, said, strict=True)]
    if draw.random() < 0.6:
        parts.insert(draw.randint(1, len(parts)), clutter(draw))
    body = draw.choice(SHELLS).format("".join(parts), for_=draw.choice(good), against=draw.choice(bad))
    around = [clutter(draw) for _ in range(draw.randint(1, 5))]
    at = draw.randint(0, len(around))
    page = Page(f"<html><body>{''.join(around[:at])}{body}{''.join(around[at:])}</body></html>")
    return page, [b.text in set(said) for b in page.blocks]


def fit(pages: int = PAGES, steps: int = STEPS) -> dict[str, float]:
    rows = [(f, y) for seed in range(pages) for page, labels in [made(seed)] for f, y in zip(features(page), labels, strict=True)]
    sign = {w: x > 0 for w, x in start.WEIGHTS.items()}
    prior = {"BIAS": -0.5, "LENGTH": 1.0, "LINKS": -4.0, "SENTENCE": 0.5} | {w: PRIOR[s] for w, s in sign.items()}
    weights = prior | HELD
    # a step is scaled by how often a name occurs, so that rare names move as well
    seen = dict.fromkeys(weights, 0.0)
    for (_, _, _, names), _ in rows:
        for w, x in names.items():
            seen[w] += x
    for _ in range(steps):
        slope = dict.fromkeys(weights, 0.0)
        for (length, links, ends, names), y in rows:
            plus = sum(weights[w] * x for w, x in names.items() if sign[w])
            z = weights["BIAS"] + weights["LENGTH"] * length + weights["LINKS"] * links + weights["SENTENCE"] * ends
            z += min(start.CAP, plus) + sum(weights[w] * x for w, x in names.items() if not sign[w])
            off = y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            for w, x in (("BIAS", 1.0), ("LENGTH", length), ("LINKS", links), ("SENTENCE", ends)):
                slope[w] += off * x / len(rows)
            for w, x in names.items():
                if not sign[w] or plus < start.CAP:
                    slope[w] += off * x / (1 + seen[w])
        for w in weights:
            moved = weights[w] + RATE * slope[w] - PULL * (weights[w] - prior[w])
            if w in sign:
                moved = min(MOST, max(0.05, moved)) if sign[w] else max(-MOST, min(-0.05, moved))
            weights[w] = HELD.get(w, moved)
    return {w: round(x, 2) for w, x in weights.items()}


if __name__ == "__main__":
    print(fit())
