"""HTML main text: the maximum-scoring contiguous region of words and tags.

A page is read as one sequence of tokens.  Words score positive and tags
negative; words inside page furniture (menus, adverts, notices, comments, ...)
score negative.  One linear scan finds the contiguous region with the best
sum, and the text of that region, without its furniture, is the article.

Weights come from labelled pages: pages with exactly one ``article`` or
``main`` element (or ``itemprop="articleBody"``) show what is inside and outside.  For every tag and
every class or id word the learner counts words inside and outside, on top of
prior counts for the usual names of page furniture; a word is furniture if the
smallest log-odds of its ancestors' features is below zero.  A furniture
name does not count on the main labelled element and what encloses it, on html and body, nor, as
part of a token of several words, on an element with almost all words of the page; a class token
counts as a whole if the learner knows it, else by its words.  Furniture explains its content away:
a list item inside a menu is no evidence against list items.  Counts come from a
bounded sample of ``MAX_TRAIN`` labelled pages (a parameter), chosen by a hash
of the page id.

A list item whose words are all linked scores negative unless it lies in the main element, so
that menus do not widen the region; inside the best region it is kept like every other block.
On a page without a main element such a list at the very end or start of the text stays outside.

Blocks are joined by a newline, white space inside a block is one space.

Edge cases: null or empty html gives the empty text, as does a page without
words outside its furniture; broken nesting closes what is open; an unclosed
script or comment runs to the end of the page; repeated rows are separate pages;
very long pages are read whole; extra columns are ignored; equal sums take the
first region; without labelled pages the prior counts decide.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import slices

MAX_TRAIN = 2_000
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    # quotes open a value only after an equals sign
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAME = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start and end part blocks of text.
BLOCK = frozenset("""address article aside blockquote body center dd details div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary
    table tbody td tfoot th thead tr ul""".split())
#: Elements that never hold article text.
HIDDEN = frozenset("head title select button object canvas audio video map".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog header".split())
#: Usual class and id words of page furniture.
FURNITURE_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs
    comment comments consent cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar
    navigation newsletter notice notices overlay pagination pager popup promo promoted promotion recommended
    related reply replies search share sharing sidebar sidenav signup skip social sponsor sponsored
    subscribe subscription tags toc toolbar topbar widget widgets""".split())
_PRIOR = 25.0
#: Words that make a class token the state of a page ("no-sidebar"), not the name of its furniture.
_STATES = frozenset("no not has have with without enabled disabled".split())
_WRAPPER_SHARE = 0.9
_CLOSES_P = BLOCK - {"html", "body"}


def _furniture_prior(feature: str) -> bool:
    kind, name = feature.split(":", 1)
    if kind == "tag":
        return name in FURNITURE_TAGS
    parts = name.split("-")
    return not _STATES.intersection(parts) and not FURNITURE_NAMES.isdisjoint(parts)


def _parts(feature: str) -> list:
    """The single words of a class token of several words that is not a state."""
    kind, name = feature.split(":", 1)
    parts = name.split("-")
    return [f"name:{x}" for x in parts] if kind == "name" and len(parts) > 1 and not _STATES.intersection(parts) else []


def _wrappers(elements: list, total: int):
    """(main element or None, function element -> features that count on it).

    The main element is the labelled one with most words that does not call itself furniture.
    A furniture name says nothing on it, on what encloses it, or on html and body; nor does a
    name of several words on an element with almost all words of the page.
    """
    own = [e for e in elements if e["label"] and e["words"]
           and not any(f.startswith("name:") and "-" not in f and _furniture_prior(f) for f in e["names"])]
    chosen = max(own, key=lambda e: e["words"], default=None)
    around, e = set(), chosen
    while e is not None:
        around.add(id(e))
        e = e["parent"]

    def counting(e: dict) -> frozenset:
        if id(e) in around or e["name"] in ("html", "body"):
            return frozenset(f for f in e["names"] if f.startswith("tag:") or not _furniture_prior(f))
        if e["words"] >= _WRAPPER_SHARE * total:
            return frozenset(f for f in e["names"] if not (f.startswith("name:") and "-" in f and _furniture_prior(f)))
        return frozenset(e["names"])

    return chosen, counting


def parse(page: str):
    """(tokens): ("text", text, features, linked, in main) and ("tag", name, block, is_end) in page order.

    ``features`` are the features of all open elements that count; ``in main`` is true inside the
    main element.  The label marks are the third kind of token, ("mark", +1 or -1).
    """
    stack, elements = [], []            # the open ones, all
    at, out, total = 0, [], 0

    def text(chunk):
        nonlocal total
        if chunk and not any(e["hidden"] for e in stack):
            chunk = html.unescape(chunk)
            n = len(chunk.split())
            total += n
            for e in stack:
                e["words"] += n
            out.append(("text", chunk, tuple(stack), any(e["name"] == "a" for e in stack)))

    def close():
        e = stack.pop()
        if e["label"]:
            out.append(("mark", -1))
        out.append(("tag", e["name"], e["name"] in BLOCK, True))

    for m in _TOKEN.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if m.group(2):
            if any(e["name"] == name for e in stack):
                while stack[-1]["name"] != name:
                    close()
                close()
            elif name == "p":
                out.append(("tag", "p", True, True))
            continue
        if name in _CLOSES_P and stack and any(e["name"] == "p" for e in stack[-3:]):
            while stack[-1]["name"] != "p":
                close()
            close()
        if name in ("li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1]["name"] == name:
            close()
        names, label = {f"tag:{name}"}, name in ("article", "main")
        for key, value in _ATTRIBUTE.findall(m.group(4)):
            value = value.strip("\"'")
            key = key.lower()
            if key == "itemprop":
                label = label or value == "articleBody"
            else:
                found = ("-".join(_NAME.findall(x)) for x in value.lower().split())
                names.update(f"name:{x}" for x in found if x)
        out.append(("tag", name, name in BLOCK, False))
        if name == "br":
            out.append(("text", " ", (), False))
        if name not in VOID and not m.group(4).rstrip().endswith("/"):
            stack.append({"name": name, "names": names, "hidden": name in HIDDEN, "label": label, "words": 0,
                          "parent": stack[-1] if stack else None})
            elements.append(stack[-1])
            if label:
                out.append(("mark", 1))
    text(page[at:])
    while stack:
        close()
    chosen, counting = _wrappers(elements, total)
    known, paths, done = {}, {}, []
    for t in out:
        if t[0] != "text":
            done.append(t)
            continue
        key = id(t[2][-1]) if t[2] else 0
        if key not in paths:
            for e in t[2]:
                if id(e) not in known:
                    known[id(e)] = counting(e)
            feats = frozenset().union(*(known[id(e)] for e in t[2]))
            # the head of an article is a part of it, the head of a page is not
            if "tag:header" in feats and any(e["name"] in ("article", "main") for e in t[2]):
                feats -= {"tag:header"}
            paths[key] = feats, any(e is chosen for e in t[2])
        done.append((*t[:2], paths[key][0], t[3], paths[key][1]))
    return done


def count_features(page: str) -> dict | None:
    """feature -> [words inside, words outside], tags counted under ``end:``; None without one label."""
    tokens = parse(page)
    if sum(1 for t in tokens if t[0] == "mark" and t[1] > 0) != 1:
        return None
    counts, inside = {}, 0
    for t in tokens:
        if t[0] == "mark":
            inside += t[1]
            continue
        if t[0] == "tag":
            found, n = [f"end:{t[1]}"], 1
        else:
            n = len(t[1].split())
            known = [f for f in t[2] if _furniture_prior(f)]
            # a class token counts as a whole, and its single words for tokens that are not known
            found = set(known or t[2])
            found |= {x for f in found for x in _parts(f) if not known or _furniture_prior(x)}
        for f in found if n else ():
            counts.setdefault(f, [0, 0])[0 if inside else 1] += n
    return counts


def fit(pages: DataFrame, key: str = "page_id", column: str = "html", limit: int = MAX_TRAIN) -> dict:
    """Log-odds of being article text, by feature, from a bounded sample of labelled pages."""
    marked = F.col(column).rlike(r"(?i)<(article|main)[\s>]|articleBody")
    chosen = (pages.where(marked).select(F.col(key).alias("k")).where(F.col("k").isNotNull())
              .distinct().orderBy(F.xxhash64("k"), "k").limit(limit))
    # at most ``limit`` ids: broadcast is bounded by that parameter
    rows = pages.select(F.col(key).alias("k"), F.col(column).alias("h")).join(F.broadcast(chosen), "k")

    def count(batches):
        for batch in batches:
            total = {}
            for page in batch.column("h").to_pylist():
                for f, (a, b) in (count_features(page or "") or {}).items():
                    have = total.setdefault(f, [0, 0])
                    have[0] += a
                    have[1] += b
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array(list(total), pa.string()),
                "inside": pa.array([v[0] for v in total.values()], pa.int64()),
                "outside": pa.array([v[1] for v in total.values()], pa.int64())})

    summed = (rows.mapInArrow(count, "feature string, inside long, outside long")
              .groupBy("feature").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b")))
    return {r["feature"]: (r["a"], r["b"]) for r in summed.collect()}


def log_odds(model: dict, feature: str) -> float:
    a, b = model.get(feature, (0, 0))
    if feature.startswith("end:"):
        return math.log((a + 1.0) / (b + 1.0))
    if feature not in model and (parts := _parts(feature)):
        return min(log_odds(model, x) for x in parts)
    prior = (1.0, _PRIOR) if _furniture_prior(feature) else (_PRIOR, 1.0)
    return math.log((a + prior[0]) / (b + prior[1]))


def extract(page: str, model: dict, memo: dict | None = None) -> str:
    """The main text of one page."""
    memo = {} if memo is None else memo
    # blocks: (words, score per word, cost of the tags before, kept inside the best region)
    blocks, words, linked, cost, current = [], [], 0, 0.0, None
    in_list, in_main = 0, False

    def flush():
        nonlocal words, linked, cost, current
        joined = " ".join("".join(words).split())
        if joined:
            only_links = linked and linked >= len(joined.split())
            # a list of links outside the main element does not widen the region
            value = -1.0 if only_links and in_list and not in_main else current
            blocks.append((joined, value, cost, current > 0, in_main))
            cost = 0.0
        words, linked, current = [], 0, None

    for t in parse(page):
        if t[0] == "text":
            value = memo.get(t[2])
            if value is None:
                value = min((log_odds(model, f) for f in t[2]), default=1.0)
                value = memo[t[2]] = 1.0 if value > 0 else max(-2.0, value)
            if t[1].strip():
                if current is not None and (value > 0) != (current > 0):
                    flush()
                current = value if current is None else min(current, value)
                in_main = t[4]
                linked += len(t[1].split()) if t[3] else 0
            words.append(t[1])
        elif t[0] == "tag":
            if t[2]:
                flush()
                if t[1] == "li":
                    in_list += -1 if t[3] else 1
            cost += min(0.6, max(0.05, 0.1 - 0.1 * memo.setdefault(t[1], log_odds(model, f"end:{t[1]}"))))
    flush()
    best, best_span, run, start = 0.0, (0, 0), 0.0, 0
    for i, (joined, value, before, *_) in enumerate(blocks):
        if run - before <= 0:
            run, start = 0.0, i
        else:
            run -= before
        n = len(joined.split())
        run += n * value if value > 0 else max(-3.0, 0.1 * n * value)
        if run > best:
            best, best_span = run, (start, i + 1)
    # the region holds at least the text of the main labelled element that it touches
    own = [i for i, b in enumerate(blocks) if b[3] and b[4]]
    if own and (not best or best_span[0] <= own[-1] and own[0] < best_span[1]):
        best_span = (min(best_span[0], own[0]), max(best_span[1], own[-1] + 1)) if best else (own[0], own[-1] + 1)
    return "\n".join(b[0] for b in blocks[best_span[0]:best_span[1]] if b[3])


def extract_text(pages: DataFrame, model: dict, column: str = "html", keep: list | None = None) -> DataFrame:
    """``keep`` columns plus ``text`` and ``n_chars`` (code points)."""
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    source = pages.select(*keep, F.col(column).alias("__html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]]
                       + ["text string", "n_chars long"])

    def run(batches):
        memo = {}
        for batch in batches:
            for part in slices(batch, "__html"):
                texts = [extract(h or "", shared.value, memo) for h in part.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    names=keep + ["text", "n_chars"])

    return source.mapInArrow(run, schema)
