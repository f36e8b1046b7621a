"""Talverk: analytics over large collections of dated, attributed text, on PySpark."""
