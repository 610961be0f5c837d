"""Spark-native extraction and structure analytics for web pages."""

import sys

from pyspark import cloudpickle

from domloom.operators.extract import extract, extract_sections
from domloom.operators.nodes import page_nodes, parse_pages
from domloom.operators.schema import Section
from domloom.operators.xpath import select_xpath
from domloom.plans.flows import learn, process, to_markdown

# Task functions travel with their code, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "Section", "extract", "extract_sections", "learn", "page_nodes", "parse_pages", "process",
    "select_xpath", "to_markdown",
]
