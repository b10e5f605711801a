"""Whole plans: experiments, reports and the registered queries."""
