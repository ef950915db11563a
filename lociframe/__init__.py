"""Spark-first analytics over interval-keyed signal, sequence and variant tables."""
