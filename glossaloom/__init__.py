"""Glossaloom: multilingual corpus operators for PySpark."""
