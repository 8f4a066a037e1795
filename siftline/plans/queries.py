"""The registered queries and their SQL, under one name each."""
from . import build, evaluate, flow

QUERIES: dict = {**build.QUERIES, **evaluate.QUERIES, **flow.QUERIES}
ORACLES: dict[str, str] = {**build.ORACLES, **evaluate.ORACLES, **flow.ORACLES}
