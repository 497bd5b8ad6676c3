"""Weights of the block classifier of ``extract``, fitted by ``block_fit``.

``python -m shockwatch.llm.block_fit`` makes the labelled training pages (1000, by seed, no given data) and prints these
values: logits, rounded to two places, names for content at least 0.05, names against it between -6 and -0.05. List
items are held at -0.1, as articles hold lists too.
"""

from __future__ import annotations

#: Evidence of a block by itself, and the most that names for content add up to.
BIAS, LENGTH, LINKS, SENTENCE, CAP = 0.17, 1.33, -4.01, 0.61, 3.0

#: Names of elements and words of class, id, role, aria-label and itemprop.
WEIGHTS = {
    "<article>": 2.5, "<main>": 2.61, "<nav>": -5.83, "<footer>": -5.89, "<aside>": -5.81, "<form>": -2.6,
    "<button>": -5.95, "<select>": -6.0, "<menu>": -5.98, "<dialog>": -5.91, "<header>": -6.0, "<head>": -5.0,
    "<label>": -5.0, "<address>": -5.89, "<p>": 0.05, "<blockquote>": 0.05, "<pre>": 0.05, "<h1>": 0.97, "<h2>": 0.5,
    "<h3>": 0.33, "<li>": -0.1, "article": 3.0, "content": 3.0, "post": 3.01, "entry": 3.0, "story": 3.0, "body": 3.0,
    "text": 3.0, "main": 3.0, "nav": -4.13, "navbar": -5.92, "navigation": -3.83, "menu": -4.18, "breadcrumb": -3.79,
    "breadcrumbs": -4.04, "header": -4.96, "masthead": -3.86, "banner": -4.95, "footer": -4.18, "foot": -4.31,
    "contentinfo": -3.85, "copyright": -3.85, "sidebar": -3.55, "side": -3.72, "aside": -4.56, "complementary": -3.64,
    "widget": -3.95, "related": -3.64, "recommended": -4.47, "ad": -4.16, "ads": -3.85, "advert": -4.96,
    "adverts": -4.91, "advertisement": -4.26, "sponsor": -4.04, "sponsored": -5.69, "promo": -3.7, "promotion": -4.83,
    "cookie": -4.41, "cookies": -4.32, "consent": -5.75, "notice": -4.3, "alert": -3.75, "popup": -4.4, "modal": -4.06,
    "overlay": -4.26, "newsletter": -3.38, "subscribe": -5.54, "signup": -3.83, "login": -3.97, "search": -3.75,
    "share": -3.99, "sharing": -4.16, "social": -3.77, "comment": -5.07, "comments": -3.66, "reply": -3.76,
    "replies": -4.06, "respond": -3.33, "disqus": -3.73, "discussion": -4.14, "pagination": -3.43, "pager": -4.18,
    "tags": -3.26, "toolbar": -4.22, "skip": -3.91, "form": -4.17,
}
