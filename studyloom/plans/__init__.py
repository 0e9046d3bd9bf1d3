"""The registered queries of the library and their SQL."""

from . import accounts, answers, client, pieces, reading, saved, study, texts, work

QUERIES = pieces.QUERIES | texts.QUERIES | study.QUERIES | work.QUERIES | accounts.QUERIES | reading.QUERIES | answers.QUERIES | saved.QUERIES | client.QUERIES
ORACLES = pieces.ORACLES | texts.ORACLES | study.ORACLES | work.ORACLES | accounts.ORACLES | reading.ORACLES | answers.ORACLES | saved.ORACLES | client.ORACLES
