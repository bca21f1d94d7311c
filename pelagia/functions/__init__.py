"""Part of pelagia; see the README for the layout."""
