"""After one exchange every peer has what the merge of all has."""

import random

from tidelog.operators import exchange


def test_exchange_is_the_merge(spark):
    r = random.Random(3)
    ops = [(rep, t * 3 + rep, f"v{rep}-{t}") for rep in range(4) for t in range(r.randint(1, 30))]
    held = []
    for peer in range(5):
        for rep in range(4):
            upto = r.choice([-1, 10, 40, 200])
            held += [(peer, *o) for o in ops if o[0] == rep and o[1] <= upto]
    logs = spark.createDataFrame(held + held[:3], "peer long, replica long, time long, value string")
    peers = spark.createDataFrame([(7,), (0,)], "peer long")
    known = {x[1:] for x in held}
    sent = exchange.lacking(logs, peers).collect()
    assert len({tuple(x) for x in sent}) == len(sent)
    assert not {tuple(x) for x in sent} & set(held)
    got = {}
    for x in exchange.exchanged(logs, peers).collect():
        got.setdefault(x["peer"], set()).add(tuple(x)[1:])
    assert all(ops == known for ops in got.values()) and set(got) == {7, 0, *(x[0] for x in held)}
    assert exchange.lacking(logs.limit(0), peers).collect() == []
