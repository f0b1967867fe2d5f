"""Graph operators over ``nodes`` and ``edges`` DataFrames."""
