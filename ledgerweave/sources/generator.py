"""A synthetic ledger: independent markets, each a sequence of payments over its own coins.

One market is as sequential as its coins are, so markets are dealt to the executors and none is held by the driver. The
same seed gives the same documents, whatever the partitions. Entities, chains and groups are numbered across markets.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ledgerweave.functions.scalar import COUNTRIES
from ledgerweave.sources.ledger import RECORD

# The size of a market and the ranges its events are drawn from.
NORMAL, CASHOUT, STEPS, PEERS = 60, 5, 800, 50
EVENTS = {"peeling": 18, "fanout": 4, "coinjoin": 5, "hard_negative": 14}
START = datetime(2026, 1, 1)
STYLES = {"tight": ((6, 10), (20, 150), (0.05, 0.12)), "medium": ((5, 9), (30, 300), (0.05, 0.15)), "loose": ((3, 5), (200, 2000), (0.08, 0.20))}
REUSE, CHANGE, INPUTS = 0.7, 0.55, (0.7, 0.2, 0.1)
AWAY, AWAY_CASHOUT, AWAY_MIX = 0.05, 0.6, 0.5
DUST = 0.02

COLUMNS = [part.split()[0] for part in RECORD.split(", ")]


def country(ip: str) -> str:
    return COUNTRIES[int(hashlib.md5(ip.encode()).hexdigest(), 16) % 10][0]


def network(ip: str) -> str:
    return f"AS{int(hashlib.md5(ip.encode()).hexdigest(), 16) % 64000 + 1000}"


class Market:
    """Coins, addresses and relaying peers of one market's entities, and the documents of its payments."""

    def __init__(self, number: int, seed: int):
        self.number, self.rng = number, random.Random(f"{seed}:{number}")
        self.now, self.documents = START, []
        self.coins: dict[int, dict[str, tuple[str, float]]] = {e: {} for e in range(NORMAL + CASHOUT)}
        self.known: dict[int, list[str]] = {e: [] for e in self.coins}
        self.peers = self._public_addresses(PEERS)
        self.home = {e: self._near_peers() for e in self.coins}
        for e in range(NORMAL):
            address = self.address(e, new=True)
            for _ in range(self.rng.randint(1, 3)):
                self.grant(e, round(self.rng.paretovariate(2.0) * 0.05 + 1e-4, 8), address)

    def _public_addresses(self, n: int) -> list[str]:
        found: dict[str, None] = {}
        while len(found) < n:
            a, b, c, d = (self.rng.randint(1, 254) for _ in range(4))
            private = a in (10, 127) or a >= 224 or (a, b) in ((192, 168), (169, 254)) or (a == 172 and 16 <= b < 32)
            if not private:
                found[f"{a}.{b}.{c}.{d}"] = None
        return list(found)

    def _near_peers(self) -> list[str]:
        """At most three peers of one country."""
        land = country(self.rng.choice(self.peers))
        same = [p for p in self.peers if country(p) == land]
        return self.rng.sample(same, min(3, len(same)))

    def address(self, entity: int, new: bool = False) -> str:
        """A known address of the entity in ``REUSE`` of the cases, else a new one."""
        if self.known[entity] and not new and self.rng.random() < REUSE:
            return self.rng.choice(self.known[entity])
        self.known[entity].append(f"bc1q{self.rng.getrandbits(152):038x}")
        return self.known[entity][-1]

    def grant(self, entity: int, amount: float, address: str | None = None) -> str:
        """A coin from outside the market; returns its name."""
        coin = f"{hashlib.sha256(f'{self.number}:{self.rng.getrandbits(128)}'.encode()).hexdigest()}:0"
        self.coins[entity][coin] = (address or self.address(entity, new=True), amount)
        return coin

    def largest(self, entity: int) -> str | None:
        return max(self.coins[entity], key=lambda c: (self.coins[entity][c][1], c), default=None)

    def _relay(self, payer: int, receivers: list[int], kind: str) -> tuple[str, str, bool]:
        chance = AWAY_MIX if kind == "coinjoin" else AWAY_CASHOUT if any(r >= NORMAL for r in receivers) else AWAY
        away = self.rng.random() < chance
        src = self.rng.choice([p for p in self.peers if p not in self.home[payer]] if away else self.home[payer])
        return src, self.rng.choice([p for p in self.peers if p != src]), away

    def pay(self, spent: list[tuple[int, str]], outs: list[tuple[int, str, float, bool]], kind: str, **extra) -> str:
        """Consume coins (owner, name), make one for each output (entity, address, amount, change), keep the document."""
        inputs = [(coin, *self.coins[owner].pop(coin)) for owner, coin in spent]
        txid = hashlib.sha256(f"{self.number}:{len(self.documents)}:{self.rng.getrandbits(128)}".encode()).hexdigest()
        src, dst, away = self._relay(spent[0][0], [o[0] for o in outs], kind)
        for n, (entity, address, amount, _) in enumerate(outs):
            self.coins[entity][f"{txid}:{n}"] = (address, amount)
        base = self.number * (NORMAL + CASHOUT)
        record = dict.fromkeys(COLUMNS) | {
            "timestamp": self.now, "src_ip": src, "dst_ip": dst, "src_port": self.rng.randint(1024, 65535), "dst_port": 8333, "txid": txid,
            "input_addresses": [a for _, a, _ in inputs], "input_prevouts": [c for c, _, _ in inputs], "input_amounts": [x for _, _, x in inputs],
            "output_addresses": [o[1] for o in outs], "output_amounts": [o[2] for o in outs], "fee": round(sum(x for _, _, x in inputs) - sum(o[2] for o in outs), 8),
            "geo_country": country(src), "asn": network(src), "label": "normal" if kind == "normal" else "illicit", "pattern_type": kind,
            "sender_entity_ground_truth": base + spent[0][0], "output_entity_ground_truth": [base + o[0] for o in outs], "is_change_ground_truth": [o[3] for o in outs],
            "coinjoin_ground_truth": kind == "coinjoin", "geo_exception_ground_truth": away,
        }
        self.documents.append(record | extra)
        return txid

    def wait(self, seconds: tuple[int, int]) -> None:
        self.now += timedelta(seconds=self.rng.randint(*seconds))

    def others(self, *but: int) -> list[int]:
        return [e for e in range(NORMAL) if e not in but]

    def name(self, kind: str, n: int) -> str:
        return f"{kind}_{self.number * EVENTS.get(kind, 1000) + n}"

    def normal(self) -> None:
        payers = [e for e in range(NORMAL) if self.coins[e]]
        if not payers:
            return
        payer = self.rng.choice(payers)
        want = self.rng.choices((1, 2, 3), INPUTS)[0]
        spent = self.rng.sample(sorted(self.coins[payer]), min(want, len(self.coins[payer])))
        total = sum(self.coins[payer][c][1] for c in spent)
        left = max(total * (1 - self.rng.uniform(0.0003, 0.001)), 1e-5)
        to = self.rng.choice(self.others(payer))
        paid = round(left * (self.rng.uniform(0.2, 0.9) if self.rng.random() < CHANGE else 1.0), 8)
        outs = [(to, self.address(to), paid, False)]
        if round(left - paid, 8) > 0:
            outs.append((payer, self.address(payer, new=True), round(left - paid, 8), True))
        self.rng.shuffle(outs)
        self.pay([(payer, c) for c in spent], outs, "normal")

    def _hops(self, owner: int, amount: float, hops: int, gap: tuple[int, int], share: tuple[float, float], split) -> None:
        """A coin handed on hop by hop; ``split(owner, hop, small, large)`` pays and tells who holds the large part."""
        self.grant(owner, round(amount, 8))
        for hop in range(hops):
            total = self.coins[owner][self.largest(owner)][1]
            left = max(total * (1 - self.rng.uniform(0.0003, 0.001)), 1e-5)
            small = round(left * self.rng.uniform(*share), 8)
            large = round(left - small, 8)
            owner = split(owner, hop, small, large)
            self.wait(gap)
            if large < DUST or not self.coins[owner]:
                return

    def peeling(self, n: int) -> None:
        style = self.rng.choice(sorted(STYLES))
        hops, gap, share = STYLES[style]

        def split(owner: int, hop: int, small: float, large: float) -> int:
            sink = NORMAL + self.rng.randrange(CASHOUT)
            outs = [(sink, self.address(sink), small, False), (owner, self.address(owner, new=True), large, True)]
            self.pay([(owner, self.largest(owner))], outs, "peeling", chain_id=self.name("chain", n), hop_index=hop, chain_style=style)
            return owner

        self._hops(self.rng.randrange(NORMAL), self.rng.uniform(5, 20), self.rng.randint(*hops), gap, share, split)

    def hard_negative(self, n: int) -> None:
        def split(owner: int, hop: int, small: float, large: float) -> int:
            a, b = self.rng.sample(self.others(owner), 2)
            self.pay([(owner, self.largest(owner))], [(a, self.address(a), small, False), (b, self.address(b), large, False)], "normal", hard_negative_chain_id=self.name("hardneg", n), hop_index=hop)
            return b

        self._hops(self.rng.randrange(NORMAL), self.rng.uniform(3, 15), self.rng.randint(2, 6), (1800, 172800), (0.05, 0.3), split)

    def fanout(self, n: int) -> None:
        k, source = self.rng.randint(6, 12), self.rng.randrange(NORMAL)
        total = round(self.rng.uniform(3, 4) * k, 8)
        coin, group = self.grant(source, total), self.name("group", n)
        takers = self.rng.sample(self.others(source), k)
        each = round(total * 0.999 / k, 8)
        txid = self.pay([(source, coin)], [(r, self.address(r), each, False) for r in takers], "fanout", group_id=group)
        self.wait((60, 600))
        centre = self.rng.choice(self.others(source, *takers))
        for place, r in enumerate(takers):
            sent = round(each * 0.999 * self.rng.uniform(0.85, 0.98), 8)
            self.pay([(r, f"{txid}:{place}")], [(centre, self.address(centre), sent, False)], "fanin", group_id=group)
            self.wait((20, 180))

    def coinjoin(self, n: int) -> None:
        k = self.rng.randint(3, 6)
        members = self.rng.sample(range(NORMAL), k)
        target = self.rng.uniform(0.05, 0.3)
        spent = [(p, self.grant(p, round(target / 0.95 + self.rng.uniform(0, 0.01), 8))) for p in members]
        each = round(sum(self.coins[p][c][1] for p, c in spent) * 0.9985 / k, 8)
        self.pay(spent, [(p, self.address(p, new=True), each, False) for p in self.rng.sample(members, k)], "coinjoin", group_id=self.name("mix", n), mix_size=k)
        self.wait((10, 60))

    def run(self, steps: int = STEPS) -> list[dict]:
        plan = [(kind, n) for kind, times in EVENTS.items() for n in range(times)]
        self.rng.shuffle(plan)
        at = dict(zip(sorted(self.rng.sample(range(20, steps - 20), len(plan))), plan, strict=True))
        for step in range(steps):
            self.normal()
            self.wait((5, 600))
            if step in at:
                kind, n = at[step]
                getattr(self, kind)(n)
        return self.documents


def generate(spark: SparkSession, markets: int = 1, seed: int = 42) -> DataFrame:
    """Transaction documents of ``markets`` independent markets of about 1,000 each, unsorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number in pdf["id"]:
                rows = pd.DataFrame(Market(int(number), seed).run(), columns=COLUMNS)
                yield rows.astype({c: "Int32" for c in ("hop_index", "mix_size")})

    return spark.range(0, markets, 1, max(1, min(markets, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, RECORD)


def in_time_order(documents: DataFrame) -> DataFrame:
    """The documents by time, ties by txid: a range-partitioned sort."""
    return documents.orderBy("timestamp", "txid")
