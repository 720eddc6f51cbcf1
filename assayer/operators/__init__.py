"""Pure DataFrame → DataFrame operators of the staging, silver, gold and reporting layers."""
