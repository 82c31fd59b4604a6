"""functions of panelcast."""
