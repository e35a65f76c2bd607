"""Univariate target analysis on Spark: bins, outcome rates, Gini, trees and reports."""

__version__ = "0.1.0"
