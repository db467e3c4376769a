"""Subject areas of documents (problem 10).

Labelling functions vote on the subject of each sentence: terms learned from hand labels (lexicon), a
short list of seed terms, the document's title (its section) and its source. A latent model learns by
expectation maximisation how often each function is right, without looking at labels; a sentence's
subjects are weighed by their posterior probability, and a document has every subject that enough of
its text is about.

The fit uses at most LABELLED labelled documents (the least in order of a hash of their id), on the
driver; its result, a table of terms as large as that sample makes it, is the only thing sent to the executors. Every
document is read whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import shared_checkpoint
from .codepoints import Rolling, chunks, code_points

#: The model is fitted on at most so many labelled documents, of so many characters together.
LABELLED, LABELLED_LETTERS = 3000, 20_000_000
#: Most subjects.
SUBJECTS = 1000
#: A subject's share of the text that is about any subject, and of the whole text.
SHARE, SHARE_OF_ALL = 0.25, 0.18
#: Times that the terms are learned anew from the sentences they decide.
ROUNDS = 4
#: The weight of terms from which a sentence is about something.
HEARD = 1.5
GRAMS = (2, 3, 4)
SLOTS = 1 << 20

# Seed terms of the subjects.
SEEDS = {
    "science": "实验 观测 探测器 量子 光谱 基因 粒子 望远镜 论文 telescope particle quantum spectrometer experiment fossil seismic",
    "law": "诉讼 法院 合同 仲裁 判决 条款 律师 立法 执行异议 lawsuit court contract plaintiff injunction arbitration statute antitrust",
    "sport": "教练 联赛 球员 决赛 半程马拉松 训练营 奖牌 转会 预赛 league coach playoff marathon referee medal fixture squad",
    "software": "代码 接口 编译器 版本 数据库 漏洞 开源 线程 容器 software compiler database code thread deploy gateway command-line",
    "finance": "银行 利率 债券 股息 信贷 融资 基金 贷款 资本 bank bond deposit loan dividend equity underwriting credit",
    "health": "医疗 门诊 患者 疫苗 诊疗 药品 护理 临床 随访 patient clinic vaccine nursing prescription rehabilitation antibiotic",
    "energy": "电网 发电 储能 风机 光伏 煤炭 电价 天然气 充电桩 grid turbine solar coal refinery hydrogen reactor pipeline",
    "appliance": "空调 冰箱 洗衣机 家电 压缩机 净水器 电视 洗碗机 以旧换新 fridge dishwasher appliance air-conditioner vacuum purifier washing",
    "farming": "农业 水稻 小麦 玉米 养殖 土壤 灌溉 生猪 渔业 crop wheat soil pig irrigation harvest feed rice",
    "education": "学校 教师 学生 课程 招生 教学 毕业 考试 助学金 school teacher student curriculum exam enrolment thesis college",
}
_LATIN = re.compile(r"[a-z]+(?:-[a-z]+)*")
_SENTENCE_ENDS = np.array([ord(c) for c in "。！？!?\n"], dtype=np.uint32)


def _terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(sentence, hash) of every term: runs of GRAMS Han characters, Latin words and pairs of them; and how many sentences there are."""
    codes, starts = code_points([t.lower() for t in texts])
    sentence, total = _sentences(codes, starts)
    han = ((codes >= 0x3400) & (codes < 0xA000)).astype(np.int32)
    rolling = Rolling(codes, 5)
    before = np.concatenate([[0], np.cumsum(han)])
    owners, hashes = [], []
    for n in GRAMS:
        at = np.flatnonzero(before[n:] - before[: max(0, len(before) - n)] == n)
        owners.append(sentence[at])
        hashes.append(rolling.slices(at, at + n))
    letter = ((codes >= ord("a")) & (codes <= ord("z"))) | (codes == ord("-"))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], letter.astype(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    long = end - begin > 1
    begin, end = begin[long], end[long]
    words = rolling.slices(begin, end)
    own = sentence[begin] if len(begin) else np.zeros(0, np.int64)
    owners.append(own)
    hashes.append(words)
    together = own[1:] == own[:-1]
    owners.append(own[1:][together])
    hashes.append((words[:-1] * np.uint64(31) + words[1:])[together])
    return np.concatenate(owners), np.concatenate(hashes), total


def _sentences(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, int]:
    """The sentence of each character; sentences are numbered over all texts."""
    close = np.isin(codes, _SENTENCE_ENDS)
    close[:-1] |= (codes[:-1] == ord(".")) & ((codes[1:] == 0x20) | (codes[1:] > 0x2E7F))
    new = np.zeros(len(codes), dtype=bool)
    new[1:] = close[:-1]
    new[starts[:-1][np.diff(starts) > 0]] = True
    number = np.cumsum(new) - 1
    return number, int(number[-1]) + 1 if len(number) else 0


@dataclass
class Lexicon:
    """Terms in slots by the upper bits of their hash; those whose slot is taken are in sorted arrays beside."""

    keys: np.ndarray
    subject: np.ndarray
    weight: np.ndarray
    shared: np.ndarray
    more: tuple[np.ndarray, np.ndarray, np.ndarray]

    @staticmethod
    def of(terms: dict[int, tuple[int, float]]) -> Lexicon:
        h = np.array(sorted(terms), dtype=np.uint64)
        subject = np.array([terms[int(x)][0] for x in h], dtype=np.int8)
        weight = np.array([terms[int(x)][1] for x in h], dtype=np.float32)
        at = (h >> np.uint64(44)).astype(np.int64)
        alone = np.ones(len(h), dtype=bool)
        alone[1:] = at[1:] != at[:-1]
        made = Lexicon(np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int8), np.zeros(SLOTS, np.float32), np.zeros(SLOTS, bool), (h[~alone], subject[~alone], weight[~alone]))
        made.keys[at[alone]], made.subject[at[alone]], made.weight[at[alone]] = h[alone], subject[alone], weight[alone]
        made.shared[at[~alone]] = True
        return made

    def scores(self, owner: np.ndarray, h: np.ndarray, n: int, subjects: int) -> np.ndarray:
        """(n, subjects) weights of the terms found."""
        at = (h >> np.uint64(44)).astype(np.int64)
        hit = self.keys[at] == h
        place, weight = owner[hit] * subjects + self.subject[at[hit]], self.weight[at[hit]]
        keys, subject, heavy = self.more
        if len(keys):
            other = np.flatnonzero(self.shared[at] & ~hit)
            found = np.minimum(np.searchsorted(keys, h[other]), len(keys) - 1)
            same = keys[found] == h[other]
            found, other = found[same], other[same]
            place, weight = np.concatenate([place, owner[other] * subjects + subject[found]]), np.concatenate([weight, heavy[found]])
        return np.bincount(place, weights=weight, minlength=n * subjects).reshape(n, subjects)


@dataclass
class Model:
    subjects: list[str]
    learned: Lexicon
    seeds: Lexicon
    sources: dict[str, int]
    accuracy: np.ndarray
    prior: np.ndarray

    def votes(self, texts: list[str], titles: list[str | None], sources: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text of each sentence, its characters, votes of the functions: a subject or -1)."""
        k = len(self.subjects)
        codes, starts = code_points([t.lower() for t in texts])
        sentence, n = _sentences(codes, starts)
        filled = ~np.isin(codes, [0x20, 0x0A, 0x0D, 0x09, 0x3000])
        size = np.bincount(sentence[filled], minlength=n)
        first = np.flatnonzero(np.concatenate([[True], np.diff(sentence) > 0])) if n else np.zeros(0, np.int64)
        text = np.searchsorted(starts, first, side="right") - 1
        owner, h, _ = _terms(texts)
        votes = np.full((n, 4), -1, dtype=np.int64)
        votes[:, 0] = _winner(self.learned.scores(owner, h, n, k), HEARD)
        votes[:, 1] = _winner(self.seeds.scores(owner, h, n, k), 0.9)
        whole = [(t or "").replace("\n", " ").replace("。", " ") or " " for t in titles]
        o, x, m = _terms(whole)
        c, s = code_points(whole)
        by_title = np.full(len(texts), -1, dtype=np.int64)
        if m:
            number, _ = _sentences(c, s)
            line = np.searchsorted(s, np.flatnonzero(np.concatenate([[True], np.diff(number) > 0])), side="right") - 1
            scores = np.zeros((len(texts), k))
            np.add.at(scores, line, self.learned.scores(o, x, m, k) + self.seeds.scores(o, x, m, k))
            by_title = _winner(scores, 0.9)
        # title and source speak of the whole text: they are asked only where the terms of a sentence don't agree
        unsure = (votes[:, 0] != votes[:, 1]) & (votes[:, 0] >= 0) & (votes[:, 1] >= 0)
        votes[:, 2] = np.where(unsure, by_title[text], -1)
        votes[:, 3] = np.where(unsure, np.array([self.sources.get(s or "", -1) for s in sources], dtype=np.int64)[text] if len(texts) else -1, -1)
        return text, size, votes

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """(sentences, subjects) probabilities; all zero where no lexicon votes."""
        return posterior(votes, self.accuracy, self.prior) * (votes[:, :2] >= 0).any(axis=1)[:, None]


def _winner(scores: np.ndarray, least: float) -> np.ndarray:
    if not len(scores):
        return np.zeros(0, np.int64)
    best = scores.argmax(axis=1)
    top = scores[np.arange(len(scores)), best]
    return np.where((top >= least) & (top * 3 > scores.sum(axis=1) * 2), best, -1)


def posterior(votes: np.ndarray, accuracy: np.ndarray, prior: np.ndarray) -> np.ndarray:
    k = len(prior)
    log = np.tile(np.log(prior), (len(votes), 1))
    for j, a in enumerate(accuracy):
        spoke = np.flatnonzero(votes[:, j] >= 0)
        log[spoke] += np.log((1 - a) / (k - 1))
        log[spoke, votes[spoke, j]] += np.log(a) - np.log((1 - a) / (k - 1))
    log -= log.max(axis=1, keepdims=True)
    p = np.exp(log)
    return p / p.sum(axis=1, keepdims=True)


def learn_accuracies(votes: np.ndarray, k: int, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation over votes alone: (how often each function is right, how frequent each subject is)."""
    accuracy, prior = np.array([0.85, 0.8, 0.6, 0.3]), np.full(k, 1 / k)
    votes = votes[(votes[:, :2] >= 0).any(axis=1)]
    for _ in range(rounds if len(votes) else 0):
        p = posterior(votes, accuracy, prior)
        prior = (p.sum(axis=0) + 1) / (len(votes) + k)
        for j in range(votes.shape[1]):
            spoke = np.flatnonzero(votes[:, j] >= 0)
            right = p[spoke, votes[spoke, j]].sum()
            accuracy[j] = min(0.98, max(1.2 / k, (right + 1) / (len(spoke) + 2)))
    return accuracy, prior


def fit(rows: list[tuple[str, str | None, str | None, list[str]]], subjects: list[str]) -> Model:
    """rows: (text, title, source, labels) of labelled documents."""
    place = {s: i for i, s in enumerate(subjects)}
    k = len(subjects)
    seeds: dict[int, tuple[int, float]] = {}
    for subject, words in SEEDS.items():
        if subject in place:
            for word in words.split():
                h = Rolling(code_points([word])[0], 5).slices(np.array([0]), np.array([len(word)]))
                seeds[int(h[0])] = (place[subject], 1.0)
    empty = Lexicon.of({})
    seed_terms = Lexicon.of(seeds)
    rows = [(text, title, source, found) for text, title, source, labels in rows if text and (found := [place[x] for x in labels if x in place])]
    model = Model(subjects, empty, seed_terms, _by_source(rows, k), np.array([0.85, 0.8, 0.6, 0.3]), np.full(k, 1 / k))
    if rows:
        texts = [r[0] for r in rows]
        owner, h, n = _terms(texts)
        codes, starts = code_points([t.lower() for t in texts])
        sentence, _ = _sentences(codes, starts)
        first = np.flatnonzero(np.concatenate([[True], np.diff(sentence) > 0]))
        text = np.searchsorted(starts, first, side="right") - 1
        target = np.zeros((len(rows), k))
        for i, r in enumerate(rows):
            target[i, r[3]] = 1 / len(r[3])
        # sentences first take their document's labels, then what the terms learned so far say of them
        told = target[text]
        seeded = seed_terms.scores(owner, h, n, k)
        weight = told * np.where(seeded.sum(axis=1) > 0, 0.2, 1.0)[:, None] + _one_sided(seeded, 0.9) * 2
        for round_ in range(ROUNDS):
            model.learned = Lexicon.of(_learn(owner, h, weight, k, 0.5 if not round_ else 0.75))
            scores = (model.learned.scores(owner, h, n, k) + 2 * seeded) * (0.5 + told)
            weight = _one_sided(scores, 0.8) * (scores.sum(axis=1, keepdims=True) >= HEARD)
        _, _, votes = model.votes(texts, [r[1] for r in rows], [r[2] for r in rows])
        model.accuracy, model.prior = learn_accuracies(votes, k)
    return model


def _one_sided(scores: np.ndarray, least: float) -> np.ndarray:
    """1 for the subject that has at least the share `least` of a sentence's score, else 0."""
    total = scores.sum(axis=1, keepdims=True)
    return ((scores >= least * total) & (total > 0)).astype(float)


def _by_source(rows: list, k: int) -> dict[str, int]:
    count: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
    for _, _, source, labels in rows:
        if source:
            count[source][labels] += 1
    return {s: int(c.argmax()) for s, c in count.items() if c.sum() >= 5 and c.max() * 2 > c.sum()}


def _learn(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, k: int, purity: float) -> dict[int, tuple[int, float]]:
    """Terms that stand for the most part in sentences of one subject."""
    order = np.lexsort((owner, h))
    o, x = owner[order], h[order]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    o, x = o[new], x[new]
    term, place = np.unique(x, return_inverse=True)
    whole = weight.sum(axis=1)
    n = np.bincount(place, weights=whole[o], minlength=len(term))
    # a term that as often stands in sentences about nothing is no term of a subject
    lone = np.bincount(place, weights=whole[o] == 0, minlength=len(term))
    open_ = (n >= 3) & (lone * 4 < n)
    new = open_[place]
    o, place = o[new], (np.cumsum(open_) - 1)[place[new]]
    term, n = term[open_], n[open_]
    total = np.stack([np.bincount(place, weights=weight[o, j], minlength=len(term)) for j in range(k)], axis=1)
    frequency = np.maximum(weight.sum(axis=0), 1e-9)
    rate = total / frequency
    lean = rate / np.maximum(rate.sum(axis=1, keepdims=True), 1e-12)
    best = lean.argmax(axis=1)
    top = lean[np.arange(len(term)), best]
    sure = top * n / (n + 1)
    good = np.flatnonzero(sure > purity)
    return {int(term[i]): (int(best[i]), float(sure[i])) for i in good}


def labelled_sample(documents: DataFrame, labels: DataFrame, bound: int = LABELLED, letters: int = LABELLED_LETTERS) -> list[tuple[str, str | None, str | None, list[str]]]:
    """Labelled documents in order of a hash of their id, at most `bound` of at most `letters` characters together; their texts whole."""
    known = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    chosen = shared_checkpoint(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    rows = shared_checkpoint(documents.select("doc_id", "text", "title", "source").join(F.broadcast(chosen), "doc_id").where("text is not null"))
    upto = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")))  # over at most `bound` documents
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= letters)
    return [(r.text, r.title, r.source, sorted(r.labels)) for r in sorted(rows.collect(), key=lambda r: r.doc_id)]


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """documents (doc_id, text, title, source), labels (doc_id, subject), subjects (subject) to (doc_id, subject, share).

    share is the subject's part of the text that is about any subject. Null, empty and blank texts and those
    about no subject have no row; exact copies and repeated rows have rows each; without labels the seed terms alone decide.
    """
    names = sorted(r.subject for r in subjects.select("subject").where("subject is not null").distinct().take(SUBJECTS + 1))
    if len(names) > SUBJECTS:
        raise ValueError(f"more than {SUBJECTS} subjects")
    if not names:
        return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("subject"), F.lit(0.0).alias("share")).limit(0)
    model = fit(labelled_sample(documents, labels), names)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = sent.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            titles, sources = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for at, part in chunks(batch.column(1).to_pylist()):
                text, size, votes = by.votes(part, titles[at : at + len(part)], sources[at : at + len(part)])
                p = by.posterior(votes)
                about = np.zeros((len(part), len(names)))
                np.add.at(about, text, p * size[:, None])
                any_ = about.sum(axis=1, keepdims=True)
                all_ = np.bincount(text, weights=size, minlength=len(part))[:, None]
                share = np.divide(about, any_, out=np.zeros_like(about), where=any_ > 0)
                i, j = np.nonzero((share >= SHARE) & (about >= SHARE_OF_ALL * all_) & (about > 0))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + i]), pa.array([names[x] for x in j], pa.string()), pa.array(share[i, j])], names=["doc_id", "subject", "share"])

    return documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "title", "source").mapInArrow(assign, "doc_id long, subject string, share double")


def corpus_shares(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, n_docs, doc_share): how many documents have each subject, and of all documents which part; subjects without documents have 0."""
    found = document_subjects(documents, labels, subjects).groupBy("subject").agg(F.count("*").alias("n"))
    total = documents.agg(F.count("*").alias("total")).scalar().alias("total")
    rows = subjects.select("subject").where("subject is not null").distinct().join(found, "subject", "left").select("subject", "n", total)
    return rows.select("subject", F.coalesce("n", F.lit(0)).cast("long").alias("n_docs"), (F.coalesce("n", F.lit(0)) / F.nullif(F.col("total"), F.lit(0))).alias("doc_share"))
