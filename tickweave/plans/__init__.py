"""Registered queries; importing the package registers all of them."""

from tickweave.plans import ledgers, queries, research, streams, upkeep, values  # noqa: F401
