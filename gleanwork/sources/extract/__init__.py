"""Readers that turn a file's bytes into text, and the router that picks one by extension."""

from gleanwork.sources.extract.router import Router, extract

__all__ = ["Router", "extract"]
