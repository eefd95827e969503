"""Scalar expressions: functions from Columns to a Column."""
