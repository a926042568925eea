"""URL filter: rules by host and path, else words segmented from the host and scored by naive Bayes.

Rules are matched with DataFrame expressions (a rule's host and all its
subdomains, a path prefix; the longest rule wins).  Other URLs are judged by
a method that learns: concatenated host names are split into words by a
unigram Viterbi search over a lexicon, and a multinomial naive Bayes
classifier scores the words of host and path.  The lexicon holds the labelled
and common words and the delimited URL tokens of all pages (the LEXICON most
frequent), counted by the sites that have them.  A name is no evidence that it
is one word itself: its own site doesn't count for it, and tokens that join
labelled or common words don't enter.  The classifier is trained on SEED_ROWS,
a labelled sample of at most 100 rows (a parameter).

Null, empty and malformed URLs have an empty host and path, fit no rule and
are judged by the prior (allow).  Repeated rows stay; extra columns pass
through ``judge``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: (rule, verdict); host, then a path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Strong words by topic, each a labelled row four times: one such word outweighs the prior, also beside a word of one allowed row.
STRONG = (
    "casino slots jackpot roulette blackjack", "poker bets betting gambling bookmaker", "porn xxx sex escort adult", "viagra cialis pills",
    "payday loans", "replica counterfeit", "crack keygen warez torrent", "hookup singles", "ads adserver banner popup tracker clickbait", "spam malware phishing scam",
)

#: Labelled rows of the classifier: words of hosts and paths.
SEED_ROWS = (
    ("block", "casino win bonus slots jackpot"), ("block", "cheap pills pharmacy online viagra"), ("block", "free porn xxx adult sex cams"),
    ("block", "payday loans fast cash credit"), ("block", "poker bet betting odds gambling"), ("block", "replica watches cheap luxury sale"),
    ("block", "crack keygen warez serial torrent"), ("block", "hot singles dating hookup adult"), ("block", "click ads tracker banner popup"),
    ("block", "earn money fast rich crypto"), ("block", "diet pills weight loss miracle"), ("block", "free download mp3 torrent movies"),
    ("block", "win prize lottery free gift"), ("block", "buy followers cheap likes seo"), ("block", "spam malware phishing login verify"),
    ("allow", "news world politics article"), ("allow", "blog post travel food"), ("allow", "docs manual guide reference"),
    ("allow", "wiki article history science"), ("allow", "university research paper library"), ("allow", "school education course student"),
    ("allow", "shop products catalog contact"), ("allow", "museum art music culture"), ("allow", "weather city map transport"),
    ("allow", "open source code project forum"), ("allow", "health hospital doctor care"), ("allow", "book review author story"),
    ("allow", "garden home family recipes"), ("allow", "sport team league results"), ("allow", "law court public council"),
    ("allow", "free software download linux computer network server data"), ("allow", "online banking login account insurance office tax"),
    ("allow", "train track race running bicycle swimming mountain lake"), ("allow", "farm garden animals nature forest birds flowers trees"),
    ("allow", "movies cinema theatre dance concert piano guitar singer"), ("allow", "sale order delivery furniture clothes shoes kitchen tools"),
    ("allow", "hotel flights beach island camping hiking holiday tours"), ("allow", "finance money market business company trade jobs career"),
    ("allow", "clinic nurse dentist medicine nutrition yoga fitness children"), ("allow", "teacher lecture exam language grammar dictionary english math"),
    ("allow", "physics chemistry biology astronomy geology climate energy water"), ("allow", "gallery painting photo design fashion architecture craft studio"),
    ("allow", "recipe bread cheese coffee wine restaurant cake soup"), ("allow", "football tennis hockey chess golf club match player"),
    ("allow", "government election parliament police justice army peace history"), ("allow", "novel poem writer magazine journal press radio television"),
    ("allow", "church religion philosophy tradition festival village town bridge"), ("allow", "car truck engine ship aircraft railway station road"),
    ("allow", "house building roof window electric plumbing paint wood"), ("allow", "dog cat horse fish zoo veterinary bees sheep"),
    ("allow", "robot sensor camera phone tablet printer battery software"), ("allow", "baby wedding birthday toys puzzle comics games stories"),
) + tuple(("block", text) for text in STRONG for _ in range(4))
#: Words that carry no label but must be known to split host names.
COMMON = "the and for you with this that from have are was your all can more has one our out about use how its who may new now old good best great big day time way web site page top info mobile example www com org net html en de fr es".split()

PRIOR_BLOCK, CACHE = 0.3, 200_000
#: Page tokens in the lexicon at most, and their letters at most.
LEXICON, LETTERS = 50_000, 32


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; empty where there is no `://`."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    after = F.when(F.locate("://", u) > 0, F.substr(u, F.locate("://", u) + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, outcome in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(outcome)).otherwise(verdict)
    return rule, verdict


def lexicon(rows=SEED_ROWS, more=COMMON) -> list[str]:
    return sorted({w for _, text in rows for w in text.split()} | set(more))


def counts(urls: DataFrame, size: int = LEXICON) -> dict[str, int]:
    """On how many sites (hosts without a leading www or m) each token stands alone between delimiters; the `size` most frequent tokens."""
    host, path = parts(urls["url"])
    site = F.regexp_replace(host, r"^(www|m)\.", "")
    token = F.explode(F.array_distinct(F.split(F.lower(F.concat(host, F.lit("/"), path)), r"[^\p{L}]+")))
    pairs = urls.select(site.alias("site"), token.alias("w")).where(F.length("w").between(2, LETTERS)).distinct()
    return {w: n for w, n in pairs.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()}


def joins(name: str, words: set[str]) -> bool:
    """Whether name is two or more of the words, each of three letters or more."""
    ends = {0}
    for end in range(3, len(name) + 1):
        if any(start in ends and name[start:end] in words for start in range(end - 2) if end - start < len(name)):
            ends.add(end)
    return len(name) in ends


class Model:
    """Viterbi segmentation and naive Bayes over its words."""

    def __init__(self, word_counts: dict[str, int], rows=SEED_ROWS, more=COMMON, prior_block: float = PRIOR_BLOCK):
        words = lexicon(rows, more)
        known = set(words)
        # every labelled word counts at least once in each row that has it
        base = Counter(w for _, text in rows for w in text.split()) + Counter(more)
        total = base + Counter({w: n for w, n in word_counts.items() if w in known or not joins(w, known)})
        n = sum(total.values())
        self.cost = {w: -math.log(c / n) for w, c in total.items() if len(w) > 1}
        #: cost of a name that is one word, its own site left out
        self.whole = {w: -math.log((c - 1) / n) for w, c in total.items() if w not in base and c > 1}
        self.base = base
        self.longest = max(map(len, total))
        self.unknown = math.log(n) + 2
        tally = {k: Counter(w for label, text in rows if label == k for w in text.split()) for k in ("block", "allow")}
        self.weight = {
            w: math.log((tally["block"][w] + 1) / (sum(tally["block"].values()) + len(words))) - math.log((tally["allow"][w] + 1) / (sum(tally["allow"].values()) + len(words)))
            for w in words if tally["block"][w] or tally["allow"][w]
        }
        self.bias = math.log(prior_block / (1 - prior_block))
        self.cache: dict[str, tuple[str, ...]] = {}

    def segment(self, name: str) -> tuple[str, ...]:
        """Words of a concatenated name; a stretch of unknown characters is one word."""
        if name in self.cache:
            return self.cache[name]
        best: list[tuple[float, int, bool]] = [(0.0, 0, True)]
        for end in range(1, len(name) + 1):
            options = [(best[end - 1][0] + self.unknown + (0 if not best[end - 1][2] and end > 1 else 2.0), end - 1, False)]
            for start in range(max(0, end - self.longest), end):
                word = name[start:end]
                c = self.whole.get(word) if len(word) == len(name) and word not in self.base else self.cost.get(word)
                if c is not None:
                    options.append((best[start][0] + c, start, True))
            best.append(min(options))
        out: list[str] = []
        at, glue = len(name), False
        while at:
            _, start, known = best[at]
            if known or not glue:
                out.append(name[start:at])
            else:
                out[-1] = name[start:at] + out[-1]
            glue, at = not known, start
        if len(self.cache) > CACHE:
            self.cache.clear()
        self.cache[name] = tuple(reversed(out))
        return self.cache[name]

    def tokens(self, host: str, path: str) -> list[str]:
        return [w for name in re.findall(r"[^\W\d_]+", f"{host} {path}".lower()) for w in self.segment(name)]

    def score(self, host: str, path: str) -> float:
        """Log odds of block."""
        return self.bias + sum(self.weight.get(w, 0.0) for w in self.tokens(host, path))


def judge(pages: DataFrame, rules=RULES, rows=SEED_ROWS, prior_block: float = PRIOR_BLOCK) -> DataFrame:
    """pages with host, path, rule, log_odds, words and verdict; input columns of these six names are replaced, all others kept."""
    names = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "log_odds", "words")]
    at, road, fit, said, found = fresh(pages.columns, "_host", "_path", "_rule", "_said", "_found")
    host, path = parts(pages["url"])
    rule, verdict = rule_of(F.col(at), F.col(road), rules)
    base = pages.withColumns({at: host, road: path}).withColumns({fit: rule, said: verdict})
    model = pages.sparkSession.sparkContext.broadcast(Model(counts(pages), rows, prior_block=prior_block))

    @F.pandas_udf("log_odds double, words string")
    def scored(hosts, paths):
        import pandas as pd

        m = model.value
        words = [m.tokens(h, p) for h, p in zip(hosts, paths)]
        return pd.DataFrame({"log_odds": [m.bias + sum(m.weight.get(w, 0.0) for w in x) for x in words], "words": [" ".join(x) for x in words]})

    odds = F.col(f"{found}.log_odds")
    return base.withColumn(found, scored(at, road)).select(
        *[F.col(f"`{c}`") for c in names], F.col(at).alias("host"), F.col(road).alias("path"), F.col(fit).alias("rule"), odds.alias("log_odds"), F.col(f"{found}.words").alias("words"),
        F.coalesce(F.col(said), F.when(odds > 0, "block").otherwise("allow")).alias("verdict"),
    )
