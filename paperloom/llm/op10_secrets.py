"""Secret scan whose false positives a random forest removes.

Candidates: strings with the form of known keys, values assigned to names that hold a word like password or token,
passwords in URLs, and long mixed tokens. No candidate, name or gap is cut at a length; reading is linear in the text.
The forest (numpy, fixed seed) is trained on labelled findings made here from templates: real secrets, and look-alikes
such as digests after "commit" or "md5", placeholders, identifiers, slugs and image data. Its features: length, shares of
character classes, transitions between classes and between characters, entropy, dictionary coverage, the path (source)
and the neighbouring words.

One row per candidate with its score and verdict; offsets count code points of the whole text. A null or empty text has no
candidates; a null source is an empty path; a null doc_id stays null; repeated rows are scanned each for themselves. Only
doc_id, text and source are read, so other columns cannot clash. The secret itself is not returned, only its SHA-256.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

TREES, DEPTH, LEAF, CUT = 40, 9, 4, 0.5
SCHEMA = "doc_id long, start long, end long, rule string, secret_sha256 string, score double, is_secret boolean"
#: Rules in order of precedence; group "v" is the candidate.
RULES = {
    "private_key": r"(?P<v>-----BEGIN (?:[A-Z0-9]+ )*?PRIVATE KEY-----[A-Za-z0-9+/=\s]*+)",
    "aws_key": r"(?<![A-Za-z0-9])(?P<v>(?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9])",
    "service_token": r"(?<![A-Za-z0-9])(?P<v>gh[pousr]_[A-Za-z0-9]{30,}+|xox[baprs]-[A-Za-z0-9-]{10,}+|sk_(?:live|test)_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,}+)",
    "jwt": r"(?<![A-Za-z0-9])(?P<v>eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)",
    "url_password": r"(?<=://)[^\s:/@\"'<>]*+:(?P<v>[^\s/@\"'<>]{6,}+)@",
    "assignment": None,  # see assignments()
    "high_entropy": r"(?<![A-Za-z0-9+/_-])(?P<v>[A-Za-z0-9+/_-]{20,}+={0,2})",
}
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
_RULES = {k: re.compile(p) for k, p in RULES.items() if p}
#: An assignment is found from its sign: the name before it holds one of these words, the value follows.
_SIGN = re.compile("[:=]")
_KEYWORD = re.compile(r"(?i)pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credentials?|private[_-]?key")
_VALUE = re.compile(r"(?::=|=>|[:=])[ \t]*+(?:Bearer )?[\"'`]?(?P<v>[^\s\"'`,;]{6,}+)")
_NAME = frozenset(string.ascii_letters + string.digits + "_-")
_GOOD = re.compile(r"(?i)pass|pwd|secret|token|key|auth|credential|bearer|login")
_BAD = re.compile(r"(?i)commit|sha|md5|checksum|digest|hash|uuid|guid|integrity|etag|revision|image|version|example|sample|dummy|placeholder|fixture|test")
_FILL = re.compile(r"(?i)example|changeme|placeholder|your[_-]?|xxxx|\*\*\*|\.\.\.|dummy|sample|redacted|todo|<[a-z]|\$\{|\{\{|%\(|os\.environ|process\.env|getenv|null|none|true|false|undefined|123456|abcdef|hunter2|secret123|password")
_PATH = re.compile(r"(?i)test|spec|doc|example|sample|fixture|mock|vendor|lock|\.md|\.svg|\.map")
WORDS = frozenset(
    "about above access account action active address admin after again agent allow already also amount answer apple application apply archive area array article async author available back base before begin "
    "being best better between block board body book both branch bring browser buffer build business button cache call cancel card case center chain change channel character check child city class clean clear "
    "client close cloud code collection color column command comment common company complete component config connect console contact contain content context control convert copy core count country course create "
    "current custom data database date debug default define delete deploy describe design detail develop device dialog different digital display document domain done double down draft drive each early edit "
    "element email empty enable encode engine enter entity entry environment error event every example execute expect export extend external factory fail family feature field figure file filter final find first "
    "float folder follow font force form format forward found frame free from front full function future game general generate get global good graph great group guide hand handle have header health height hello "
    "help here high history home host house human image import include index info input insert inside install instance integer interface internal issue item java json just keep kernel keyboard label language large "
    "last later layer layout leader learn left length letter level library light line link list listen live load local lock logger login long look machine mail main make manager many market master match math matter "
    "maximum media member memory menu merge message method middle minimum mobile model module money monitor month more most mount move movie multi music name native need network never next node none normal note "
    "number object offer office often only open option order other output over override owner package page paint panel paper parent parse part party pass password path pattern payment people person phone picture "
    "place plan platform play please plugin point policy position post power prefix present price print private problem process product profile program project property protocol provider proxy public push query "
    "queue quick random range rate read ready real reason record reference region register release remote remove render repeat replace report request require reset resource response rest result return review right "
    "role room root route rule runtime safe sample save scale schedule schema scope screen script scroll search second secret section secure select send sequence serial server service session set setting shape share "
    "shell short show side sign simple single site size small social software sort source space special speed split stack standard start state static status step still stock stop storage store stream string strong "
    "style submit subject success support switch symbol sync system table target task team template test text theme thing thread through time title today token tool topic total trace track transaction transfer "
    "transform tree trigger true type under union unique unit update upload user using util valid value variable vector version video view visible wait want watch water week welcome white widget width window with "
    "word work world write your zero the and for are not you all can her was one our out day had has his how man new now old see two way who did its let put say she too use".split()
)


def _coverage(s: str) -> float:
    """Share of characters that the longest dictionary words cover, read from the left."""
    s = s.lower()
    i = hit = 0
    while i < len(s):
        for n in range(min(12, len(s) - i), 2, -1):
            if s[i : i + n] in WORDS:
                hit += n
                i += n
                break
        else:
            i += 1
    return hit / max(1, len(s))


@lru_cache(1)
def _bigrams() -> dict[str, float]:
    """Log share of each character pair in dictionary words, add-one smoothed."""
    count: dict[str, int] = {}
    for w in sorted(WORDS):
        for a, b in zip(w, w[1:]):
            count[a + b] = count.get(a + b, 0) + 1
    total = sum(count.values()) + 26 * 26
    return {a + b: math.log((count.get(a + b, 0) + 1) / total * 676) for a in string.ascii_lowercase for b in string.ascii_lowercase}


def features(secret: str, rule: str, before: str, after: str, path: str) -> list[float]:
    n = len(secret)
    kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s" for c in secret]
    share = [kinds.count(k) / n for k in "dlus"]
    counts = [secret.count(c) for c in set(secret)]
    entropy = -sum(k / n * math.log2(k / n) for k in counts)
    low = secret.lower()
    table_ = _bigrams()
    pairs = [table_.get(low[i : i + 2], -1.0) for i in range(n - 1)]
    near = before[-40:]
    return [
        float(min(n, 300)),
        *share,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        sum(pairs) / max(1, len(pairs)),
        entropy,
        entropy / math.log2(max(2, min(n, 64))),
        max(counts) / n,
        _coverage(secret),
        float(all(c in "0123456789abcdefABCDEF" for c in secret)),
        float(n in (32, 40, 64)),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", secret))),
        float(bool(_GOOD.search(near))),
        float(bool(_BAD.search(near))),
        float(bool(_BAD.search(after[:30]))),
        float(bool(_FILL.search(secret))),
        float(bool(_PATH.search(path))),
        float("base64," in near or "/" in secret and secret.count("/") > 2),
        float(list(RULES).index(rule)),
    ]


def labelled_findings(n: int = 3000, seed: int = 5) -> list[tuple[str, str, str, str, str, int]]:
    """(secret, rule, before, after, path, label) found in lines made from templates."""
    r = random.Random(seed)
    words = sorted(WORDS)
    pick = lambda alphabet, a, z=None: "".join(r.choice(alphabet) for _ in range(r.randint(a, z or a)))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    some = lambda k: " ".join(r.choice(words) for _ in range(k))
    key = lambda: r.choice(["password", "passwd", "PASSWORD", "token", "secret", "api_key", "API_KEY", "access_key", "db_password", "client_secret", "auth_key"])
    sep = lambda: r.choice(["=", " = ", ": ", ":"])
    good = [
        lambda: f"{some(2)} {key()}{sep()}{r.choice(['', chr(34)])}{pick(hexa, r.choice([16, 18, 20, 24, 32, 40, 64]))}",
        lambda: f"{key()}{sep()}{pick(alnum, 10, 44)}",
        lambda: f"{key()}{sep()}'{pick(alnum + '!@#%^&*-_', 9, 30)}'",
        lambda: f"{key()}{sep()}{r.choice(words)}{pick('0123456789', 2, 5)}{pick('!@#%', 1, 3)}{pick(alnum, 2, 5)}",
        lambda: f"{some(3)} AKIA{pick(string.ascii_uppercase + string.digits, 16)} {some(2)}",
        lambda: f"{some(1)} ghp_{pick(alnum, 36)}",
        lambda: f"xoxb-{pick('0123456789', 11)}-{pick(alnum, 24)}",
        lambda: f"sk_live_{pick(alnum, 24)}",
        lambda: f"Authorization: token {pick(alnum + '+/', 40)}",
        lambda: f"eyJ{pick(alnum, 20, 60)}.eyJ{pick(alnum, 30, 90)}.{pick(alnum + '-_', 43)}",
        lambda: f"-----BEGIN RSA PRIVATE KEY-----\n{pick(alnum + '+/', 300)}",
        lambda: f"{r.choice(['', 'export '])}{r.choice(['ENCRYPTION_KEY', 'SIGNING', 'SIGNING_KEY', 'MASTER_KEY', 'HMAC', 'SALT', 'CIPHER', r.choice(words).upper()])}={pick(alnum, 20, 44)}",
        lambda: f"{r.choice(['ENCRYPTION_KEY', 'SIGNING_KEY', 'MASTER_KEY', 'HMAC_KEY', 'signing_key', 'cipher_key'])}={pick(hexa, r.choice([32, 40, 64]))}",
        lambda: f"{r.choice(['postgres', 'mysql', 'https', 'amqp', 'redis'])}://{r.choice(words)}:{pick(alnum + '!$%^*-_', 8, 30)}@{r.choice(words)}.example.com:5432/{r.choice(words)}",
        lambda: f"https://{r.choice(words)}.com/{r.choice(words)}?{r.choice(['sig', 'signature', 'sv', 'code', 'key'])}={pick(alnum, 20, 44)}",
    ]
    bad = [
        lambda: f"commit {pick(hexa, 40)} {some(2)}",
        lambda: f"{r.choice(['md5', 'sha1', 'sha256', 'checksum', 'digest', 'etag', 'integrity', 'revision'])}{sep()}{pick(hexa, r.choice([32, 40, 64]))}",
        lambda: f"uuid {pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}",
        lambda: f"{key()}{sep()}{r.choice(['changeme', 'your_password_here', 'example123', 'xxxxxxxxxxxx', '********', '${DB_PASSWORD}', '{{ secret }}', 'os.environ[KEY]', 'process.env.TOKEN', 'undefined', 'placeholder', 'YOUR_API_KEY'])}",
        lambda: f"{key()}{sep()}{r.choice(words)}",
        lambda: f"{key()}{sep()}{r.choice(words)}{r.choice(['_', '-', '.', ''])}{r.choice(words)}{r.choice(['()', '', ')', '[0]'])}",
        lambda: f"{some(2)} {'_'.join(r.choice(words) for _ in range(5))}_{pick('0123456789', 1, 3)}",
        lambda: f"{some(2)} {''.join(r.choice(words).title() for _ in range(5))}{pick('0123456789', 1, 2)}",
        lambda: f"/{'/'.join(r.choice(words) for _ in range(5))}/{pick('0123456789', 1, 6)}",
        lambda: f"https://{r.choice(words)}.com/{'-'.join(r.choice(words) for _ in range(6))}-{pick('0123456789', 3, 8)}",
        lambda: f"data:image/png;base64,{pick(alnum + '+/', 60, 400)}",
        lambda: f"{some(2)} {pick('0123456789', 20, 40)}",
        lambda: f"{some(1)} {pick('ab01', 1) * r.randint(20, 40)}1",
        lambda: f"sample sk_test_{pick('0', 8)}{pick('0123456789', 16)}",
        lambda: f"{r.choice(['COMMIT', 'GIT_SHA', 'MD5', 'SHA256', 'CHECKSUM', 'IMAGE_DIGEST', 'REVISION', 'ETAG'])}={pick(hexa, r.choice([32, 40, 64]))}",
        lambda: f"{r.choice(words).upper()}={r.choice(['_', '-', '/']).join(r.choice(words) for _ in range(5))}{r.choice(['_', '-'])}{pick('0123456789', 1, 3)}",
        lambda: f"https://{r.choice(words)}.com/?{r.choice(['title', 'page', 'q', 'id'])}={'-'.join(r.choice(words) for _ in range(5))}-{pick('0123456789', 1, 6)}",
        lambda: f"{r.choice(words)}?id={pick('0123456789', 20, 30)}a",
        lambda: f"{r.choice(['postgres', 'mysql', 'https', 'amqp'])}://{r.choice(words)}:{r.choice(['password', 'changeme', 'xxxxxxxx', '${DB_PASSWORD}', '<password>', 'your_password', '******'])}@{r.choice(['localhost', 'db.example.com'])}/{r.choice(words)}",
    ]
    out = []
    while len(out) < n:
        label = r.random() < 0.5
        line = f"{some(r.randint(0, 6))}\n{r.choice(good if label else bad)()} {some(r.randint(0, 6))}"
        path = r.choice(["src/app.py", "config/prod.env", "src0", "src7", "deploy.yaml", ""]) if label or r.random() < 0.6 else r.choice(["tests/test_app.py", "docs/readme.md", "package.lock"])
        found = candidates(line)
        if len(found) == 1:
            s, e, rule = found[0]
            out.append((line[s:e], rule, line[max(0, s - 60) : s], line[e : e + 40], path, int(label)))
    return out


def assignments(text: str) -> Iterator[tuple[int, int]]:
    """Values assigned to names that hold a keyword, in one pass over the signs."""
    done = 0
    for m in _SIGN.finditer(text):
        at = m.start()
        if at < done:
            continue
        i = at
        while i > done and text[i - 1] in " \t":
            i -= 1
        if i > done and text[i - 1] in "\"'":
            i -= 1
        end = i
        while i > done and text[i - 1] in _NAME:
            i -= 1
        if i < end and _KEYWORD.search(text, i, end) and (v := _VALUE.match(text, at)):
            done = v.end()
            yield v.span("v")


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, rule) of the candidates of a whole text; of overlapping ones the rule named first stays."""
    taken: list[tuple[int, int, str]] = [(s, e, "assignment") for s, e in assignments(text)]
    for rule, pattern in _RULES.items():
        for m in pattern.finditer(text):
            s, e = m.span("v")
            if rule == "high_entropy" and not (_LETTER.search(text, s, e) and _DIGIT.search(text, s, e)):
                continue
            taken.append((s, e, rule))
    if len(taken) < 2:
        return taken
    order = list(RULES)
    out: list[tuple[int, int, str]] = []
    for s, e, rule in sorted(taken, key=lambda x: (x[0], order.index(x[2]))):
        while out and s < out[-1][1] and order.index(rule) < order.index(out[-1][2]):
            out.pop()
        if not out or s >= out[-1][1]:
            out.append((s, e, rule))
    return out


class Forest:
    """Random forest of Gini splits; a tree is arrays of feature, threshold, children and share of positives."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.trees = []
        tries = max(2, int(math.sqrt(x.shape[1])) + 1)
        for _ in range(TREES):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []

            def grow(rows: np.ndarray, depth: int, nodes: list = nodes) -> int:
                at = len(nodes)
                nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
                if depth == DEPTH or len(rows) < 2 * LEAF or y[rows].min() == y[rows].max():
                    return at
                best = (1e9, -1, 0.0)
                for f in rng.choice(x.shape[1], tries, replace=False):
                    v = x[rows, f]
                    order = np.argsort(v, kind="stable")
                    v, t = v[order], y[rows][order]
                    k = np.flatnonzero(v[1:] > v[:-1]) + 1
                    k = k[(k >= LEAF) & (k <= len(v) - LEAF)]
                    if not len(k):
                        continue
                    left = np.cumsum(t)[k - 1]
                    right = t.sum() - left
                    impurity = left * (1 - left / k) + right * (1 - right / (len(v) - k))
                    i = int(np.argmin(impurity))
                    if impurity[i] < best[0]:
                        best = (float(impurity[i]), int(f), float(v[k[i] - 1]))
                if best[1] >= 0:
                    down = x[rows, best[1]] <= best[2]
                    nodes[at][:2] = best[1:]
                    nodes[at][2] = grow(rows[down], depth + 1)
                    nodes[at][3] = grow(rows[~down], depth + 1)
                return at

            grow(rows, 0)
            self.trees.append(np.array(nodes))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f = t[at, 0].astype(int)
                inner = f >= 0
                down = x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1]
                at = np.where(inner, np.where(down, t[at, 2], t[at, 3]).astype(int), at)
            total += t[at, 4]
        return total / len(self.trees)


@lru_cache(1)
def forest() -> Forest:
    rows = labelled_findings()
    return Forest(np.array([features(*r[:5]) for r in rows]), np.array([r[5] for r in rows], float))


def secrets(docs: DataFrame, model: Forest | None = None) -> DataFrame:
    """One row for each candidate in ``docs`` (doc_id, text, source)."""
    ship(docs.sparkSession)
    model = model or forest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = [], []
            for doc, text, path in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("source").to_pylist()):
                for s, e, rule in candidates(text) if text else ():
                    own = text[s:e]
                    rows.append((doc, s, e, rule, hashlib.sha256(own.encode("utf-8", "replace")).hexdigest()))
                    x.append(features(own, rule, text[max(0, s - 60) : s], text[e : e + 40], path or ""))
            score = model.score(np.array(x)) if x else np.empty(0)
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(score, pa.float64()), pa.array(score >= CUT, pa.bool_())], names=["doc_id", "start", "end", "rule", "secret_sha256", "score", "is_secret"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    return own.mapInArrow(run, SCHEMA)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
