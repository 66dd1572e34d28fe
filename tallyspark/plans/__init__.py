"""From statements to one Catalyst plan."""
