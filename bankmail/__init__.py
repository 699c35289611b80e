"""bankmail: bank e-mails to tables, reports and search, as Spark DataFrame operators."""

from bankmail.session import build_session

__all__ = ["build_session"]
